"""Operators on pixels, control points and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.geodesy import latlon_to_enu
from terraloom.functions.stages import dealt

c = F.col
#: Fixed value: what a point that misses the ground counts as, in both errors.
MISS_DEGREES = 100.0


def pixel_grid(cameras: DataFrame, width: int, height: int, step: int) -> DataFrame:
    """Every camera's pixels (u, v) at each ``step``; rows from the top, then columns.

    Cameras are few and become very many rows, so they are dealt out to all cores first:
    a table of one small file would be one task."""
    rows = dealt(cameras).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))))
    rows = rows.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step))))
    return rows.withColumns({"u": c("u").cast("double"), "v": c("v").cast("double")})


def residuals(df: DataFrame) -> DataFrame:
    """Adds err_lat, err_lon (degrees) and err_m between lat, lon and known_lat,
    known_lon, in the plane about the camera; NaN for a miss."""
    df = latlon_to_enu(df, "known_lat", "known_lon", "cam_lat", "cam_lon", "_ke", "_kn")
    df = latlon_to_enu(df, "lat", "lon", "cam_lat", "cam_lon", "_pe", "_pn")
    or_nan = lambda x: F.coalesce(x, F.lit(float("nan")))
    df = df.withColumns({"err_lat": or_nan(c("lat") - c("known_lat")), "err_lon": or_nan(c("lon") - c("known_lon")), "err_m": or_nan(F.hypot(c("_pe") - c("_ke"), c("_pn") - c("_kn")))})
    return df.drop("_ke", "_kn", "_pe", "_pn")


def aoi_ring(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """Adds ``ring``: the closed box of half-width radius_m about a position, lon first."""
    dlat, dlon = F.lit(radius_m / 111320), radius_m / (111320 * F.cos(F.radians(lat)))
    at = lambda x, y: F.array(c(lon) + x * dlon, c(lat) + y * dlat)
    return df.withColumn("ring", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1)))


def apply_similarity(df: DataFrame, scale: float, rotation: list[float], shift: list[float]) -> DataFrame:
    """Adds sx, sy, sz: scale * R * (x, y, z) + shift."""
    axes = ("x", "y", "z")
    return df.withColumns({f"s{a}": scale * sum((rotation[3 * i + j] * c(b) for j, b in enumerate(axes)), F.lit(0.0)) + shift[i] for i, a in enumerate(axes)})


def label_by_order(df: DataFrame, by: list[str], order: list[str], prefix: str) -> DataFrame:
    """Adds ``label``: the prefix and the row's ordinal within its group, from 1."""
    return df.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def select_by_grid(df: DataFrame, by: list[str], order: list[str], width: int, height: int, most: int, cols: int = 4, rows: int = 3) -> DataFrame:
    """At most one point (u, v) of each grid cell of each group, the first in order, and
    at most ``most`` points of a group."""
    cell = lambda x, size, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(c(x) / max(1, size / n)))).cast("int")
    df = df.withColumns({"cell_col": cell("u", width, cols), "cell_row": cell("v", height, rows)})
    first = Window.partitionBy(*by, "cell_col", "cell_row").orderBy(*order)
    rank = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("_r", F.row_number().over(rank)).where(c("_r") <= most).drop("_r")


def stride(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Every k-th row of each group, from its first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(c("_r") % k == 0).drop("_r")


def close_ring(ring: Column, always: bool = True) -> Column:
    """The ring with its first vertex again at its end; if not ``always``, only if the
    last vertex differs."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return closed if always else F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(closed)
