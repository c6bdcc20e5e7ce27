"""Queries of elevation grids, matches and headings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import surface
from terraloom.plans.views import sql, view

c = F.col
X0, Y0, Y1, CELL, COLS, ROWS = 0.0, 0.0, 75.0, 0.5, 200, 150
#: Degrees from magnetic to true north.
DECLINATION = -11.5


def grid_max_dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.grid_max(view(spark, sf_dir, "point"), X0, Y1, CELL, COLS, ROWS).select("row", "col", F.round("z", 4).alias("z"))


def grid_max_las(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.grid_max_clipped(view(spark, sf_dir, "point"), X0, Y0, 1.0, 90, 70).select("row", "col", F.round("z", 4).alias("z"))


def dsm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = surface.grid_max(view(spark, sf_dir, "point"), X0, Y1, CELL, COLS, ROWS)
    z = (F.round(f("z"), 4).alias(n) for f, n in ((F.min, "z_min"), (F.max, "z_max"), (F.avg, "z_mean"), (F.stddev_pop, "z_std")))
    return cells.agg(F.count("*").alias("cells"), F.round(F.count("*") / (COLS * ROWS), 6).alias("coverage"), *z)


def pose_above_dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = surface.grid_max(view(spark, sf_dir, "point"), X0, Y1, CELL, COLS, ROWS)
    df = surface.above_grid(view(spark, sf_dir, "pose"), cells, X0, Y1, CELL)
    where = F.when(c("above").isNull(), "outside").when(c("above") < 0, "below").otherwise("inside")
    return df.select("pose_id", where.alias("place"), F.round("above", 4).alias("above"))


def corr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = view(spark, sf_dir, "obs").select(c("image_id").alias("img_a"), c("kp_id").alias("kp_a"), "pt_id")
    return view(spark, sf_dir, "match").join(seen, ["img_a", "kp_a"]).select("match_id", "pt_id", "u", "v")


def untriangulated_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, left = view(spark, sf_dir, "obs"), view(spark, sf_dir, "match")
    for k in "ab":
        left = left.join(seen.select(c("image_id").alias(f"img_{k}"), c("kp_id").alias(f"kp_{k}")), [f"img_{k}", f"kp_{k}"], "left_anti")
    return left.select("match_id", "img_a", "img_b")


def heading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "imu").withColumn("h", F.pmod(c("yaw") + DECLINATION, F.lit(360.0)))
    return df.groupBy("node").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("mean_deg"), F.round(F.stddev_pop("h"), 6).alias("std_deg"))


DSM_SQL = sql("point") + f", placed AS (SELECT floor(({Y1}e0 - y)/{CELL}e0)::BIGINT AS row, floor((x - {X0}e0)/{CELL}e0)::BIGINT AS col, z FROM v_point), cells AS (SELECT row, col, max(z) AS z FROM placed WHERE row BETWEEN 0 AND {ROWS - 1} AND col BETWEEN 0 AND {COLS - 1} GROUP BY row, col)"

ORACLE = {
    "grid_max_dsm": DSM_SQL + " SELECT row, col, round(z, 4) AS z FROM cells",
    "grid_max_las": sql("point") + ", placed AS (SELECT least(69, greatest(0, trunc(y)::BIGINT)) AS row, least(89, greatest(0, trunc(x)::BIGINT)) AS col, z FROM v_point) SELECT row, col, round(max(z), 4) AS z FROM placed GROUP BY row, col",
    "dsm_stats": DSM_SQL + f" SELECT count(*) AS cells, round(count(*)/{COLS * ROWS}e0, 6) AS coverage, round(min(z), 4) AS z_min, round(max(z), 4) AS z_max, round(avg(z), 4) AS z_mean, round(stddev_pop(z), 4) AS z_std FROM cells",
    "pose_above_dsm": DSM_SQL + ", " + sql("pose").removeprefix("WITH ") + f", p AS (SELECT v_pose.*, alt - z AS above FROM v_pose LEFT JOIN cells ON row = trunc(({Y1}e0 - y)/{CELL}e0) AND col = trunc((x - {X0}e0)/{CELL}e0)) SELECT pose_id, CASE WHEN above IS NULL THEN 'outside' WHEN above < 0 THEN 'below' ELSE 'inside' END AS place, round(above, 4) AS above FROM p",
    "corr_join": sql("match", "obs") + " SELECT match_id, pt_id, u, v FROM v_match JOIN v_obs ON img_a = image_id AND kp_a = kp_id",
    "untriangulated_anti": sql("match", "obs") + " SELECT match_id, img_a, img_b FROM v_match WHERE NOT EXISTS (SELECT 1 FROM v_obs WHERE image_id = img_a AND kp_id = kp_a) AND NOT EXISTS (SELECT 1 FROM v_obs WHERE image_id = img_b AND kp_id = kp_b)",
    "heading_stats": sql("imu") + f", h AS (SELECT node, CASE WHEN yaw + ({DECLINATION}e0) < 0 THEN yaw + ({DECLINATION}e0) + 360 ELSE yaw + ({DECLINATION}e0) END AS h FROM v_imu) SELECT node, count(*) AS n, round(avg(h), 6) AS mean_deg, round(stddev_pop(h), 6) AS std_deg FROM h GROUP BY node",
}

QUERIES = {f.__name__: f for f in (grid_max_dsm, grid_max_las, dsm_stats, pose_above_dsm, corr_join, untriangulated_anti, heading_stats)}
