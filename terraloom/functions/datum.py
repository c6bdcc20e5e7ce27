"""Vertical datums: which one a model is in, warnings, and heights moved between them.

No geoid is built in: its heights above the ellipsoid come as a table of cells, and a
height is moved by the one at its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
ELLIPSOID, EGM96, EGM2008, NAVD88 = "ellipsoid", "egm96", "egm2008", "navd88"


def infer(wkt: Column) -> Column:
    """The datum that a model's description names, else null."""
    low = F.lower(wkt)
    return F.when(low.contains("egm96") | wkt.contains("5773"), EGM96).when(low.contains("egm2008") | wkt.contains("3855"), EGM2008).when(low.contains("navd"), NAVD88)


def mismatch(source: Column, elevation: Column, terrain: Column, datum: Column, above_ground: Column) -> Column:
    """The datum that a camera's elevation is taken to be in where it differs from the
    terrain's; null where nothing is mixed.  An unnamed datum counts as the ellipsoid."""
    settled = elevation.isNull() | above_ground | (source == "dem_plus_height")
    own = F.coalesce(datum, F.lit(ELLIPSOID))
    return F.when(~F.coalesce(settled, F.lit(False)) & (own != terrain), own)


def warning(own: Column, terrain: Column) -> Column:
    return F.when(own.isNotNull(), F.concat(F.lit("camera elevation in "), own, F.lit(" but terrain in "), terrain))


def move(df: DataFrame, geoid: DataFrame, height: str, source: str, target: str, cell: float = 1.0) -> DataFrame:
    """Adds ``moved`` and ``moved_ok``: the height in the target datum.  geoid: datum,
    lat_cell, lon_cell and offset (its height above the ellipsoid).  Where an offset that
    is needed is missing, the height stays as it is and isn't ok."""
    at = df.withColumns({"lat_cell": F.floor(c("lat") / cell), "lon_cell": F.floor(c("lon") / cell)})
    for k, datum in (("_from", source), ("_to", target)):
        own = geoid.select(c("datum").alias(datum), "lat_cell", "lon_cell", c("offset").alias(k))
        at = at.join(own, [datum, "lat_cell", "lon_cell"], "left").withColumn(k, F.when(c(datum) == ELLIPSOID, 0.0).otherwise(c(k)))
    told = F.when(c(source) == c(target), c(height)).otherwise(c(height) + c("_from") - c("_to"))
    return at.withColumns({"moved": F.coalesce(told, c(height)), "moved_ok": told.isNotNull()}).drop("lat_cell", "lon_cell", "_from", "_to")


def camera_elevation(ground: Column, mount: Column) -> Column:
    """A camera's elevation above known ground."""
    return F.when(ground.isNotNull(), ground + mount)
