"""Queries of fitted models.  Solvers have no SQL and are tested on planted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import fitting
from terraloom.plans.views import CX, CY, FX, FY, sql, view

c = F.col


def tps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.fit_spline(view(spark, sf_dir, "gcp").withColumn("cam_id", F.floor(c("cam_id") / 3)), "cam_id")


def tps_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = view(spark, sf_dir, "gcp").select("cam_id", F.when(c("gcp_id") % 5 > 1, c("pixel_u")).alias("px"), F.when(c("gcp_id") % 5 > 1, c("pixel_v")).otherwise((c("gcp_id") % 5).cast("double")).alias("py"), ((c("gcp_id") % 7) * 1e-9).alias("w_lat"), ((c("gcp_id") % 9) * 1e-9).alias("w_lon"))
    pixels = view(spark, sf_dir, "match").select("match_id", (c("img_a")).alias("cam_id"), "u", "v")
    return fitting.apply_spline(pixels, weights, "cam_id", "match_id").select("match_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def umeyama(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = view(spark, sf_dir, "pose").withColumns({"scan": F.floor(c("pose_id") / 20), "z": c("alt")})
    pairs = pts.withColumns({"tx": 1.5 * (0.8 * c("x") - 0.6 * c("y")) + 10, "ty": 1.5 * (0.6 * c("x") + 0.8 * c("y")) - 20, "tz": 1.5 * c("z") + 5})
    return fitting.fit_similarity(pairs, "scan")


def refine_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.refine_poses(view(spark, sf_dir, "gcp").join(view(spark, sf_dir, "camera"), "cam_id"), "cam_id", (FX, FY, CX, CY))


ORACLE = {
    "tps_eval": sql("gcp", "match") + ", w AS (SELECT cam_id, CASE WHEN gcp_id % 5 > 1 THEN pixel_u END AS px, CASE WHEN gcp_id % 5 > 1 THEN pixel_v ELSE gcp_id % 5 END AS py, (gcp_id % 7)*1e-9 AS wa, (gcp_id % 9)*1e-9 AS wo FROM v_gcp), t AS (SELECT match_id, wa, wo, CASE WHEN px IS NULL THEN CASE py WHEN 0 THEN 1 WHEN 1 THEN u ELSE v END WHEN (u-px)*(u-px) + (v-py)*(v-py) > 0 THEN 0.5e0*((u-px)*(u-px) + (v-py)*(v-py))*ln((u-px)*(u-px) + (v-py)*(v-py)) ELSE 0 END AS t FROM v_match JOIN w ON img_a = cam_id) SELECT match_id, round(sum(t*wa), 6) AS lat, round(sum(t*wo), 6) AS lon FROM t GROUP BY match_id",
}

QUERIES = {f.__name__: f for f in (tps_fit, tps_eval, umeyama, refine_pose)}
