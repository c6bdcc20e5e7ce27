"""Session settings that the engine's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Long chains of geometry columns make methods beyond the size that the JVM compiles;
#: with this limit Spark then generates a method for each step instead of one for all.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
