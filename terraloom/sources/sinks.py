"""Writers of tables, reports, features and clouds.

Each writes a folder of parts, as many as the table has partitions; ``one_file`` makes a
single part of a table that is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom import schemas
from terraloom.operators import inspection, listing, points

c = F.col
CLICKED = ["label", "pixel_u", "pixel_v", "lat", "lon", "dist_m"]
TERRAIN = [*CLICKED[:5], "elev_m", "slant_range_m"]
PLY = "ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header"


def one_file(df: DataFrame) -> DataFrame:
    return df.coalesce(1)


def _csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.options(header=True, emptyValue="", nullValue="").csv(path)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def write_gcps(df: DataFrame, path: str) -> None:
    """Control points; a null elevation is empty."""
    _csv(df, path, _names(schemas.GCP))


def write_grid(df: DataFrame, path: str) -> None:
    _csv(df, path, _names(schemas.GRID_POINT))


def write_clicked(df: DataFrame, path: str, terrain: bool = False) -> None:
    _csv(df, path, TERRAIN if terrain else CLICKED)


def write_poses(df: DataFrame, path: str) -> None:
    _csv(df, path, _names(schemas.CAMERA_POSE))


def write_boundary(df: DataFrame, path: str) -> None:
    """lon, lat and elev_m of a boundary's vertices."""
    _csv(df, path, ["lon", "lat", "elev_m"])


def write_report(judged: DataFrame, path: str) -> None:
    """A line for each calibration image, after a header."""
    judged.select(*inspection.report_columns()).write.options(header=True, emptyValue="").csv(path)


def write_intrinsics(df: DataFrame, path: str) -> None:
    """Calibrations (fx, fy, cx, cy, distortion, width, height, rms, camera_height_m) as JSON."""
    zero, one = F.lit(0.0), F.lit(1.0)
    k = F.array(F.array("fx", zero, "cx"), F.array(zero, "fy", "cy"), F.array(zero, zero, one))
    df.select(k.alias("K"), F.array("distortion").alias("D"), F.array("width", "height").alias("img_size"), "rms", "camera_height_m").write.option("ignoreNullFields", False).json(path)


def features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A point feature of each row, its other columns as properties."""
    rest = [x for x in df.columns if x not in (lon, lat)]
    return df.select(listing.feature(c(lon), c(lat), F.struct(*rest)).alias("value"))


def polygon(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """A polygon feature of each group's vertices (lon, lat) in order, its ring closed; a
    group of fewer than three vertices gives none.  A task holds one ring."""
    rings = df.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"])).alias("ring")).where(F.size("ring") >= 3)
    ring = points.close_ring(c("ring"), always=False)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return rings.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(name).alias("name")).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_features(made: DataFrame, path: str) -> None:
    """Features as lines of text, one each."""
    made.select("value").write.text(path)


def write_collection(made: DataFrame, path: str) -> None:
    """Few features as one collection in a single file."""
    one = made.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    one.write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Scenes, manifests and other records as JSON lines."""
    df.write.option("ignoreNullFields", False).json(path)


def write_ply(cloud: DataFrame, path: str) -> None:
    """Points (x, y, z, r, g, b) as an ASCII cloud in one file: its header counts all."""
    lines = cloud.select(F.lit(1).alias("part"), F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", "r", "g", "b").alias("value"))
    head = cloud.agg(F.count("*").cast("string").alias("n")).select(F.lit(0).alias("part"), F.replace(F.lit(PLY), F.lit("{n}"), c("n")).alias("value"))
    head.union(lines).coalesce(1).sortWithinPartitions("part").select("value").write.text(path)
