"""A sensor's log as a stream: corrected headings, alerts, calibration and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terraloom import schemas
from terraloom.functions.scalars import wrap_360

c = F.col
#: A magnetometer below this state isn't calibrated; a stage is done at FULL.
MAG_MIN, FULL = 2, 3
STAGES = ("gyro", "accel", "mag")
PROGRESS = "node long, ts timestamp, stage string, done boolean"


def read_log(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """The rows of log files as they appear in a folder."""
    return spark.readStream.schema(schemas.IMU).options(header=True, maxFilesPerTrigger=files_a_batch).csv(folder).withColumn("ts", F.to_timestamp("timestamp"))


def corrected(readings: DataFrame, declination: float, correction: float = 0.0) -> DataFrame:
    """Log rows of raw readings (timestamp, pitch, roll, heading, temp, states): the heading
    is true, angles have three decimals and temperatures one.  Batch or stream."""
    true = wrap_360(c("heading") + declination + correction)
    states = [c(f"calib_{k}") for k in ("sys", "gyro", "accel", "mag")]
    return readings.select("timestamp", F.round("pitch", 3).alias("tilt_deg"), F.round("roll", 3).alias("roll_deg"), F.round(true, 3).alias("yaw_deg"), F.round("temp", 1).alias("temp_c"), *states)


def alerts(log: DataFrame) -> DataFrame:
    """Rows whose magnetometer isn't calibrated."""
    return log.where(c("calib_mag") < MAG_MIN)


def heading_windows(log: DataFrame, by: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Mean and spread of headings in windows of time; rows later than ``late`` don't count."""
    timed = log.withWatermark("ts", late)
    return timed.groupBy(by, F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("yaw_deg").alias("mean_deg"), F.stddev_pop("yaw_deg").alias("std_deg")).select(by, c("window.start").alias("start"), "n", "mean_deg", "std_deg")


def nearest_reading(images: DataFrame, log: DataFrame, by: str, within: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Images with all readings of their node within a span of time, and how far off each
    is: the least gap is taken where the result is read.  Streams, both with a watermark."""
    left = images.withWatermark("taken", late).alias("i")
    right = log.withWatermark("ts", late).alias("r")
    span = F.expr(f"r.ts BETWEEN i.taken - INTERVAL {within} AND i.taken + INTERVAL {within}")
    gap = F.abs(F.unix_micros("r.ts") - F.unix_micros("i.taken"))
    return left.join(right, (c(f"i.{by}") == c(f"r.{by}")) & span, "leftOuter").select("i.*", c("r.ts").alias("ts"), c("r.yaw_deg").alias("yaw_deg"), gap.alias("gap_us"))


def guided_calibration(log: DataFrame) -> DataFrame:
    """PROGRESS of each node through gyro, accel and mag, in that order: a row whenever a
    stage begins or is done.  A stage that is done stays done."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (at,) = state.get if state.exists else (-1,)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for row in rows.itertuples():
            if at < 0:
                at = 0
                out.append((key[0], row.ts, STAGES[0], False))
            while at < len(STAGES) and getattr(row, f"calib_{STAGES[at]}") >= FULL:
                out.append((key[0], row.ts, STAGES[at], True))
                at += 1
                if at < len(STAGES):
                    out.append((key[0], row.ts, STAGES[at], False))
        state.update((at,))
        yield pd.DataFrame(out, columns=["node", "ts", "stage", "done"])

    return log.groupBy("node").applyInPandasWithState(step, PROGRESS, "at int", "append", GroupStateTimeout.NoTimeout)


def append_log(log: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to CSV files, each row once; returns the query."""
    return log.writeStream.format("csv").option("header", True).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
