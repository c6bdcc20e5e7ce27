"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terraloom.llm.shared import delete, let_go, materialise, new_path


def components(links: DataFrame) -> DataFrame:
    """node, component (its component's smallest node) for each node of ``links`` (a, b).

    Large-star and small-star rounds (each node's neighbours are moved to the
    smallest one) until nothing moves; each round is written and the one before goes.  A node's links
    meet as a minimum that is combined before the shuffle, and a join that adaptive
    execution may split, so a node with very many links holds nothing up.
    """
    spark, before = links.sparkSession, []

    def state(df: DataFrame) -> tuple[DataFrame, tuple]:
        before.append(new_path(spark, "star"))
        seen = Observation()
        marks = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        df = materialise(df.distinct().observe(seen, *marks), "star", before[-1])
        if len(before) > 1:
            delete(spark, before.pop(0))
        return df, (seen.get["n"], seen.get["sum"])

    def star(edges: DataFrame, large: bool) -> DataFrame:
        around = edges.union(edges.select("v", "u")) if large else edges  # u > v in edges
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("from"))
        if large:
            return moved.where(F.col("u") > F.col("from")).select("u", "v")
        return moved.select("u", "v").where("u <> v").union(least.select("u", F.col("m").alias("v")))

    edges, mark = state(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while mark[0]:
        edges, after = state(star(star(edges, True), False).where("u > v"))
        if after == mark:
            break
        mark = after
        let_go(spark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
