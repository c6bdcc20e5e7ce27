"""The shared folder, lineage cuts and small helpers that all operators use."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local master may go
    without that setting; it then gets a folder of its own under the temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = os.path.join(tempfile.gettempdir(), "checkpoints", "terraloom")
    os.makedirs(base, exist_ok=True)
    return f"file://{base}"


#: Rows of an Arrow batch and, where Spark can cut batches by size, its bytes.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended by now
            pass


atexit.register(_clean)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is deleted when Python exits."""
    path = f"{shared_base(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Deletes the shuffle files of a statement when it has ended.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How written tables are stored: zstd's buffers are bounded, and row groups and pages
#: stay small also where texts are very long.
WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "10"}


def materialise(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and
    a lost executor costs a file read instead of a recomputation.  The shuffles that led
    to it aren't needed any more, and their files go at once."""
    spark = df.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, tag)
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.options(**WRITER).parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Collect the garbage of ended statements: plans that Python still refers to, then
    the driver's heap, which would else grow to its limit and stay there, and with it what
    Spark's cleaner holds for them, on the executors too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables that go when the block that needs them ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            self.drop()

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(new_path(self.spark, tag))
        return materialise(df, tag, self.paths[-1])

    def drop(self) -> None:
        """Delete the table written last."""
        path = self.paths.pop()
        delete(self.spark, path)
        _made.remove((self.spark, path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> F.Column:
    """Array of the maximal runs without ASCII white space; null or empty text: []."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value, body) -> F.Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]
