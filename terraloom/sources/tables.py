"""Readers of the files that cameras, sensors and scans leave behind.

Files of rows are read by Spark in parallel; a reader that must not lose a row fails on a
bad one, one that may skips it, as its docstring says.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom import schemas
from terraloom.operators.listing import file_suffix

c = F.col
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def _csv(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).options(header=True, mode=mode, enforceSchema=False, ignoreTrailingWhiteSpace=True).csv(path)


def read_gcps(spark: SparkSession, path: str) -> DataFrame:
    """Control points; a bad number or a missing column is an error, an empty elevation null.
    A file without the column of elevations is read too."""
    has = "elev_m" in spark.read.option("header", True).csv(path).columns
    schema = schemas.GCP if has else schemas.GCP.removesuffix(", elev_m DOUBLE")
    df = _csv(spark, path, schema).withColumn("label", F.trim("label"))
    return df if has else df.withColumn("elev_m", F.lit(None).cast("double"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid points; a file with a header only gives no rows."""
    return _csv(spark, path, schemas.GRID_POINT)


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """One row: fx, fy, cx, cy, distortion, width, height (null if not named), rms and
    camera_height_m."""
    df = spark.read.schema(schemas.INTRINSICS).option("multiLine", True).json(path)
    k = c("K")
    return df.select(k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"), c("D")[0].alias("distortion"), c("img_size")[0].alias("width"), c("img_size")[1].alias("height"), "rms", "camera_height_m")


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """A sensor's log, with ts_us and the row's place in its file."""
    df = _csv(spark, path, schemas.IMU).withColumn("place", c("_metadata.file_block_start") * 0 + F.monotonically_increasing_id())
    return df.withColumn("ts_us", F.unix_micros(F.to_timestamp("timestamp")))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Camera poses; rows without a position that can be read are left out."""
    text = spark.read.option("header", True).csv(path)
    names = [f.split()[0] for f in schemas.CAMERA_POSE.split(", ")]
    number = lambda n: (c(n) if n in text.columns else F.lit(None).cast("string")).try_cast("double").alias(n)
    return text.select("frame_id", *map(number, names[1:])).where("lat_deg IS NOT NULL AND lon_deg IS NOT NULL AND alt_ellipsoid_m IS NOT NULL")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of a scan as camera poses; what a capture lacks is null."""
    df = spark.read.schema(schemas.OPF_CAPTURES).option("multiLine", True).json(path).select(F.explode("captures").alias("k"))
    at = lambda x, i: F.get(c(x), F.lit(i))
    parts = [("lat_deg", "k.geolocation.coordinates", 0), ("lon_deg", "k.geolocation.coordinates", 1), ("alt_ellipsoid_m", "k.geolocation.coordinates", 2), ("sigma_h_m", "k.geolocation.sigmas", 0), ("sigma_v_m", "k.geolocation.sigmas", 2)]
    parts += [(f"{p}{n}_deg", f"k.orientation.{x}", i) for p, x in (("", "angles_deg"), ("sigma_", "sigmas_deg")) for i, n in enumerate(("yaw", "pitch", "roll"))]
    return df.select(F.coalesce("k.id", F.lit("")).alias("frame_id"), *(at(x, i).alias(n) for n, x, i in parts))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def read_scene_frame(spark: SparkSession, folder: str) -> DataFrame:
    """shift and crs of a scan's reference frame; crs may be text or hold a definition."""
    path = first_existing(spark, [f"{folder}/opf_files/scene_reference_frame.json", f"{folder}/point_clouds/legacy/scene_reference_frame.json"])
    df = spark.read.schema(schemas.SCENE_FRAME).option("multiLine", True).json(path)
    return df.select(c("base_to_canonical.shift").alias("shift"), F.coalesce(F.get_json_object("crs", "$.definition"), "crs").alias("crs"))


def read_cloud(spark: SparkSession, folder: str, points_a_row: int = 100_000) -> DataFrame:
    """Points x, y, z and r, g, b (0 to 255) of a scan's interleaved cloud; a file shorter
    than it says is an error.  Parts of the file are read by tasks of their own."""
    base = f"{folder}/point_clouds/legacy"
    told = spark.read.option("multiLine", True).json(f"{base}/pointcloud.gltf").select(c("accessors")[0]["count"].alias("n"), c("bufferViews")[0]["byteStride"].alias("stride")).first()
    n, stride = int(told.n), int(told.stride)
    path = f"{base}/pointcloud.bin"
    size = spark.read.format("binaryFile").load(path).select("length").first()[0]
    if size < n * stride:
        raise ValueError(f"{path} has {size} bytes of {n * stride}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with store.open_input_file(name) as file:
            for pdf in parts:
                for lo in pdf["id"]:
                    rows = min(points_a_row, n - int(lo))
                    v = np.frombuffer(file.read_at(rows * stride, int(lo) * stride), "<f4").reshape(rows, stride // 4)
                    rgb = np.clip(v[:, 3:6] * np.float32(255), 0, 255).astype(np.int32)
                    yield pd.DataFrame({**{k: v[:, i].astype(float) for i, k in enumerate("xyz")}, **{k: rgb[:, i] for i, k in enumerate("rgb")}})

    return spark.range(0, n, points_a_row).mapInPandas(run, schemas.POINT)


def list_files(spark: SparkSession, folder: str, *, deep: bool = False, glob: str | None = None, suffixes: Sequence[str] = IMAGE_SUFFIXES, limit: int | None = None) -> DataFrame:
    """path and length of a folder's files with these suffixes of any case, each once and
    in order; hidden folders aren't looked into.  No file's content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    df = reader.load(folder).select("path", "length")
    if not deep:
        df = df.where(F.endswith(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit(folder.rstrip("/").split(":")[-1].lstrip("/"))))
    df = df.where(file_suffix(c("path")).isin(*suffixes)).dropDuplicates(["path"]).orderBy("path")
    return df if limit is None else df.limit(limit)


def read_rows(spark: SparkSession, path: str, where: str | None = None, limit: int = 50_000) -> DataFrame:
    """Rows of an open-data set kept as JSON, filtered and limited as its server would."""
    df = spark.read.json(path)
    return (df.where(where) if where else df).limit(limit)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of a search's answer: id, acquired, cloud_cover and gsd."""
    df = spark.read.schema(f"features ARRAY<STRUCT<{schemas.SCENE.replace('id STRING', 'id: STRING', 1).replace('properties STRUCT', 'properties: STRUCT')}>>").option("multiLine", True).json(path).select(F.explode("features").alias("s"))
    return df.select("s.id", F.to_timestamp("s.properties.acquired").alias("acquired"), "s.properties.cloud_cover", "s.properties.gsd")


def read_mask(spark: SparkSession, table: DataFrame, threshold: int = 127) -> DataFrame:
    """The pixels of a mask (x, y, v) that count as set."""
    return table.where(c("v") > threshold).select("x", "y")
