"""Columns that build on each other, one projection after another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def staged(df: DataFrame, steps: Sequence[dict[str, Column]], keep: Sequence[str]) -> DataFrame:
    """Add each step's columns in turn; of all added ones only ``keep`` stay.

    All steps are one select, in which columns refer to those named before them, so the
    plan is analysed once; only where a name is given twice each step is one of its own."""
    names = [name for step in steps for name in step]
    added = set(names) - set(keep)
    if len(set(names)) == len(names) and not set(names) & set(df.columns):
        return df.select("*", *(e.alias(name) for step in steps for name, e in step.items())).drop(*added)
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*added)


def dealt(df: DataFrame) -> DataFrame:
    """``df``'s rows dealt out evenly, in at least as many tasks as there are cores."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
