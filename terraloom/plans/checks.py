"""Queries that judge images, terrain and readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import scalars
from terraloom.operators import inspection, surface, terrain
from terraloom.plans.relational import CELL, COLS, DSM_SQL, ROWS, X0, Y1
from terraloom.plans.views import sql, view

c = F.col
GRID = terrain.Grid(X0, Y1, CELL, COLS, ROWS)
BEARING, DECLINATION = 90.0, -11.5


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.verdicts(view(spark, sf_dir, "calib_img"))


def calib_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _judged(spark, sf_dir)
    return df.select("image_id", *(x for x in df.columns if x.startswith("pass_")), "selected", F.concat_ws("; ", "reasons").alias("reasons"))


def calib_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _judged(spark, sf_dir)
    return df.select("image_id", inspection.report_line().alias("line"))


def calib_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.diversity(_judged(spark, sf_dir), "session_id")


def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.rejections(_judged(spark, sf_dir))


def calib_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.sufficiency(_judged(spark, sf_dir), "session_id")


def reproj_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspection.pixel_rms(view(spark, sf_dir, "reproj"), "image_id", c("dx"), c("dy"))
    return found.select("image_id", F.round("rms_scalar", 8).alias("rms_scalar"), F.round("rms_point", 8).alias("rms_point"))


def seen_by_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")) < 1.5
    return view(spark, sf_dir, "reproj").where((c("za") > 0) & (c("zb") > 0) & near).select("obs_id")


def outlier_3sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.without_outliers(view(spark, sf_dir, "calib_img"), "session_id", "sharpness", 1.0).select("image_id")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("sharpness", p), 6).alias(f"p{int(p * 100)}")
    return view(spark, sf_dir, "calib_img").groupBy("session_id").agg(*map(q, (0.02, 0.5, 0.95, 0.98)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.grid_max(view(spark, sf_dir, "point"), X0, Y1, CELL, COLS, ROWS)


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.sample(view(spark, sf_dir, "pose"), _cells(spark, sf_dir), GRID, truncate=True).select("pose_id", (c("alt") - c("z")).alias("above"))


def dsm_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.dsm_checks(_cells(spark, sf_dir), _heights(spark, sf_dir), ROWS, COLS, CELL, 0.05, 6347, 6347)


def height_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inspection.height_stats(_heights(spark, sf_dir))
    return s.select(*(F.round(x, 6).alias(x) for x in ("median", "lowest", "highest")), "below", "outside")


def terrain_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inspection.describe(_cells(spark, sf_dir).withColumn("z", F.when(c("row") % 7 == 0, -9999.0).otherwise(c("z"))), "z", -9999.0)
    return s.select("cells", "valid", *(F.round(x, 6).alias(x) for x in ("lowest", "highest", "mean")))


def terrain_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inspection.extents(view(spark, sf_dir, "point"), "x", "y", "z")
    return s.select(*(F.round(x, 6).alias(x) for x in s.columns))


def image_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).select(F.floor(c("row") / 10).alias("image_id"), c("col").alias("x"), (c("row") % 10).alias("y"), F.round((c("z") - 100) * 20).alias("v"))
    s = inspection.sharpness(cells, "image_id")
    return s.select(c("image_id").cast("bigint").alias("image_id"), F.round("sharpness", 6).alias("sharpness"), F.round("brightness", 6).alias("brightness"))


def terrain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = view(spark, sf_dir, "ray").select("ray_id", (c("e0") * 1.2).alias("x"), (c("n0") * 1.2).alias("y"))
    return terrain.sample(rays, _cells(spark, sf_dir), GRID).select("ray_id", F.round("z", 4).alias("z"))


def terrain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, coarse = _cells(spark, sf_dir), surface.grid_max(view(spark, sf_dir, "point"), X0, Y1, 5.0, 20, 15)
    rays = view(spark, sf_dir, "ray").select("ray_id", (c("e0") * 1.2).alias("x"), (c("n0") * 1.2).alias("y"))
    found = terrain.sample_first(rays, [(cells.where("(row + col) % 3 = 0"), GRID), (coarse, terrain.Grid(X0, Y1, 5.0, 20, 15))], "ray_id")
    return found.select("ray_id", "tile", F.round("z", 4).alias("z"))


def locate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "ray").withColumns({"point": F.when(c("ray_id") % 4 == 0, c("z0")), "ground": F.when(c("ray_id") % 3 == 0, c("z0") + 1), "plane": F.when(c("z") < 0, c("z0") + 2)})
    return terrain.ladder(df, ("3d", "point"), ("terrain", "ground"), ("flat", "plane")).select("ray_id", "mode", "found")


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))
    return view(spark, sf_dir, "ray").where("x <> 0 OR y <> 0 OR z <> 0").select("ray_id", "e0", "n0", "z0", *((c(k) / norm).alias(d) for k, d in zip("xyz", ("de", "dn", "du"))))


def _march(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return terrain.first_crossings(_rays(spark, sf_dir), _cells(spark, sf_dir), GRID, name).select("ray_id", "t_lo", "t_hi")

    return query


def ray_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rays meet the ground by the first march; its test is a brute-force march."""
    return terrain.first_crossings(_rays(spark, sf_dir), _cells(spark, sf_dir), GRID, "a")


def heading_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "imu").withColumn("h", scalars.wrap_360(c("yaw") + DECLINATION))
    mean = df.groupBy("node").agg(F.avg("h").alias("m"), F.avg(F.sin(F.radians("h"))).alias("s"), F.avg(F.cos(F.radians("h"))).alias("k"))
    error = scalars.wrap_180(c("m") - BEARING)
    grade = F.when(F.abs(error) > 5, "warning").when(F.abs(error) > 2, "caution").otherwise("good")
    return mean.select("node", F.round(error, 6).alias("error_deg"), grade.alias("grade"), F.round(F.hypot("s", "k"), 6).alias("agreement"))


def gps_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "gcp").groupBy("cam_id").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"))


def align_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sqrt(c("dx") * c("dx") + c("dy") * c("dy"))
    return view(spark, sf_dir, "reproj").groupBy("image_id").agg(F.round(F.avg(d), 8).alias("mean_error"), F.round(F.max(d), 8).alias("max_error"))


_JUDGED = sql("calib_img") + """, g AS (SELECT *, sharpness >= 100 AS pass_sharpness, brightness BETWEEN 40 AND 220 AS pass_exposure, corners_found AS pass_corners,
  NOT corners_found OR coverage BETWEEN 0.05e0 AND 0.90e0 AS pass_coverage, NOT corners_found OR tilt_deg >= 5 AS pass_tilt, reproj_error <= 1.5e0 AS pass_reproj FROM v_calib_img),
  j AS (SELECT *, pass_sharpness AND pass_exposure AND pass_corners AND pass_coverage AND pass_tilt AND pass_reproj AS selected,
  concat_ws('; ', CASE WHEN NOT pass_sharpness THEN 'sharpness' END, CASE WHEN NOT pass_exposure THEN 'exposure' END, CASE WHEN NOT pass_corners THEN 'corners' END, CASE WHEN NOT pass_coverage THEN 'coverage' END, CASE WHEN NOT pass_tilt THEN 'tilt' END, CASE WHEN NOT pass_reproj THEN 'reproj' END) AS reasons FROM g)"""
_POSED = DSM_SQL + ", " + sql("pose").removeprefix("WITH ") + f", h AS (SELECT pose_id, alt - z AS above FROM v_pose LEFT JOIN cells ON row = trunc(({Y1}e0 - y)/{CELL}e0) AND col = trunc((x - {X0}e0)/{CELL}e0))"
_RAYS = DSM_SQL + ", " + sql("ray").removeprefix("WITH ")


def _march_sql(step: float, reach: int, start: int, name: str) -> str:
    """Samples of every ray joined to cells, then the first crossing.  The scene's box is
    125 m across, so samples up to 160 m are all that can have data."""
    samples = f", u AS (SELECT ray_id, e0, n0, z0, x/sqrt(x*x+y*y+z*z) AS de, y/sqrt(x*x+y*y+z*z) AS dn, z/sqrt(x*x+y*y+z*z) AS du FROM v_ray WHERE x <> 0 OR y <> 0 OR z <> 0), s AS (SELECT ray_id, k * {step}e0 AS t, z0 + k * {step}e0 * du AS zr, floor(({Y1}e0 - (n0 + k * {step}e0 * dn))/{CELL}e0) AS r, floor((e0 + k * {step}e0 * de - {X0}e0)/{CELL}e0) AS q FROM u, range({start}, {int(min(reach, 160) / step) + 1}) a(k)), g AS (SELECT ray_id, t, zr - z AS g FROM s JOIN cells ON r = row AND q = col), b AS (SELECT *, lag(g) OVER w AS pg, lag(t) OVER w AS pt FROM g WINDOW w AS (PARTITION BY ray_id ORDER BY t))"
    found = {"a": "pg > 0 AND g <= 1e-5", "b": "pg IS NOT NULL AND g <= 0", "c": f"pg IS NOT NULL AND pt = t - {step}e0 AND g <= 0"}[name]
    before = "arg_min(pt, t)" if name == "a" else f"min(t) - {step}e0"
    return _RAYS + samples + f" SELECT ray_id, {before} AS t_lo, min(t) AS t_hi FROM b WHERE {found} GROUP BY ray_id"


ORACLE = {
    "calib_verdict": _JUDGED + " SELECT image_id, pass_sharpness, pass_exposure, pass_corners, pass_coverage, pass_tilt, pass_reproj, selected, reasons FROM j",
    "calib_report": _JUDGED + " SELECT image_id, concat_ws(',', image_id, printf('%.1f', sharpness), printf('%.1f', brightness), printf('%.4f', coverage), printf('%.2f', tilt_deg), printf('%.4f', reproj_error), CASE WHEN selected THEN 'yes' ELSE 'no' END, reasons) AS line FROM j",
    "calib_diversity": _JUDGED + ", k AS (SELECT *, least(2, trunc(board_x*3)) AS cx, least(2, trunc(board_y*3)) AS cy FROM j WHERE selected), d AS (SELECT session_id, count(*) AS n, count(DISTINCT (cx, cy)) AS cells, bool_or(cx IN (0, 2) OR cy IN (0, 2)) AS at_edge, max(tilt_deg) - min(tilt_deg) AS tilt_range FROM k GROUP BY session_id) SELECT *, cells < 4 AS few_cells, NOT at_edge AS no_edge, tilt_range < 10 AS narrow_tilt FROM d",
    "reject_histogram": _JUDGED + " SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM j WHERE reasons <> '') GROUP BY reason",
    "calib_sufficiency": _JUDGED + ", k AS (SELECT session_id, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS rejected FROM j GROUP BY session_id) SELECT *, CASE WHEN selected < 6 THEN 'too few' WHEN selected < 15 THEN 'usable' ELSE 'good' END AS tier FROM k",
    "reproj_rms": sql("reproj") + " SELECT image_id, round(sqrt(sum(dx*dx + dy*dy)/(2*count(*))), 8) AS rms_scalar, round(sqrt(avg(dx*dx + dy*dy)), 8) AS rms_point FROM v_reproj GROUP BY image_id",
    "seen_by_both": sql("reproj") + " SELECT obs_id FROM v_reproj WHERE za > 0 AND zb > 0 AND sqrt(dx*dx + dy*dy) < 1.5e0",
    "outlier_3sigma": sql("calib_img") + ", b AS (SELECT session_id, median(sharpness) + stddev_pop(sharpness) AS bound FROM v_calib_img GROUP BY 1) SELECT image_id FROM v_calib_img JOIN b USING (session_id) WHERE sharpness < bound",
    "percentiles": sql("calib_img") + " SELECT session_id, round(quantile_cont(sharpness, 0.02), 6) AS p2, round(quantile_cont(sharpness, 0.5), 6) AS p50, round(quantile_cont(sharpness, 0.95), 6) AS p95, round(quantile_cont(sharpness, 0.98), 6) AS p98 FROM v_calib_img GROUP BY 1",
    "dsm_checks": _POSED + f", s AS (SELECT count(z) AS n, min(z) AS lo, max(z) AS hi FROM cells), p AS (SELECT count(*) FILTER (above < 0) AS below, median(above) AS med, min(pose_id) FILTER (above < 0) AS off FROM h) SELECT 'crs' AS check, true AS passed, 'EPSG:6347' AS detail UNION ALL SELECT 'resolution', false, '{CELL:.4f}' UNION ALL SELECT 'z_min', coalesce(lo > 100, false), coalesce(printf('%.2f', lo), 'none') FROM s UNION ALL SELECT 'z_max', coalesce(hi < 125, false), coalesce(printf('%.2f', hi), 'none') FROM s UNION ALL SELECT 'valid_cells', n > 0, concat(n, ' of {ROWS * COLS}') FROM s UNION ALL SELECT 'above_surface', below = 0, concat(below, ' below, first ', coalesce(off::VARCHAR, 'none')) FROM p UNION ALL SELECT 'median_height', coalesce(med BETWEEN 0.5 AND 10, false), coalesce(printf('%.2f', med), 'none') FROM p",
    "height_stats": _POSED + " SELECT round(median(above), 6) AS median, round(min(above), 6) AS lowest, round(max(above), 6) AS highest, count(*) FILTER (above < 0) AS below, count(*) FILTER (above IS NULL) AS outside FROM h",
    "terrain_describe": DSM_SQL + " SELECT count(*) AS cells, count(*) FILTER (row % 7 <> 0) AS valid, round(min(z) FILTER (row % 7 <> 0), 6) AS lowest, round(max(z) FILTER (row % 7 <> 0), 6) AS highest, round(avg(z) FILTER (row % 7 <> 0), 6) AS mean FROM cells",
    "terrain_extents": sql("point") + " SELECT round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM v_point",
    "image_sharpness": DSM_SQL + ", p AS (SELECT (row // 10)::BIGINT AS image_id, col AS x, row % 10 AS y, round((z - 100) * 20) AS v FROM cells), n AS (SELECT *, lag(v) OVER r AS ra, lead(v) OVER r AS rb, lag(v) OVER k AS ka, lead(v) OVER k AS kb FROM p WINDOW r AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y)), l AS (SELECT image_id, v, coalesce(ra, rb, v) + coalesce(rb, ra, v) + coalesce(ka, kb, v) + coalesce(kb, ka, v) - 4*v AS lap FROM n) SELECT image_id, round(var_pop(lap), 6) AS sharpness, round(avg(v), 6) AS brightness FROM l GROUP BY image_id",
    "terrain_sample": _RAYS + f" SELECT ray_id, round(c.z, 4) AS z FROM v_ray r LEFT JOIN cells c ON c.row = floor(({Y1}e0 - n0*1.2e0)/{CELL}e0) AND c.col = floor((e0*1.2e0 - {X0}e0)/{CELL}e0)",
    "terrain_fallback": _RAYS + f", coarse AS (SELECT floor(({Y1}e0 - y)/5e0) AS row, floor((x - {X0}e0)/5e0) AS col, max(z) AS z FROM v_point GROUP BY 1, 2 HAVING row BETWEEN 0 AND 14 AND col BETWEEN 0 AND 19) SELECT ray_id, CASE WHEN a.z IS NOT NULL THEN 0 WHEN b.z IS NOT NULL THEN 1 END AS tile, round(coalesce(a.z, b.z), 4) AS z FROM v_ray r LEFT JOIN cells a ON a.row = floor(({Y1}e0 - n0*1.2e0)/{CELL}e0) AND a.col = floor((e0*1.2e0 - {X0}e0)/{CELL}e0) AND (a.row + a.col) % 3 = 0 LEFT JOIN coarse b ON b.row = floor(({Y1}e0 - n0*1.2e0)/5e0) AND b.col = floor((e0*1.2e0 - {X0}e0)/5e0)",
    "locate_ladder": sql("ray") + " SELECT ray_id, CASE WHEN ray_id % 4 = 0 THEN '3d' WHEN ray_id % 3 = 0 THEN 'terrain' WHEN z < 0 THEN 'flat' END AS mode, CASE WHEN ray_id % 4 = 0 THEN z0 WHEN ray_id % 3 = 0 THEN z0 + 1 WHEN z < 0 THEN z0 + 2 END AS found FROM v_ray",
    "ray_first_crossing": _march_sql(0.5, 5000, 0, "a"),
    "ray_march_b": _march_sql(1.0, 500, 1, "b"),
    "ray_march_c": _march_sql(1.0, 500, 1, "c"),
    "heading_residual": sql("imu") + f", h AS (SELECT node, CASE WHEN yaw + ({DECLINATION}e0) < 0 THEN yaw + ({DECLINATION}e0) + 360 ELSE yaw + ({DECLINATION}e0) END AS h FROM v_imu), m AS (SELECT node, avg(h) AS m, avg(sin(radians(h))) AS s, avg(cos(radians(h))) AS k FROM h GROUP BY node), e AS (SELECT *, m - {BEARING}e0 + 180 - 360*floor((m - {BEARING}e0 + 180)/360) - 180 AS e FROM m) SELECT node, round(e, 6) AS error_deg, CASE WHEN abs(e) > 5 THEN 'warning' WHEN abs(e) > 2 THEN 'caution' ELSE 'good' END AS grade, round(sqrt(s*s + k*k), 6) AS agreement FROM e",
    "gps_centroid": sql("gcp") + " SELECT cam_id, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM v_gcp GROUP BY cam_id",
    "align_error": sql("reproj") + " SELECT image_id, round(avg(sqrt(dx*dx + dy*dy)), 8) AS mean_error, round(max(sqrt(dx*dx + dy*dy)), 8) AS max_error FROM v_reproj GROUP BY image_id",
}

QUERIES = {f.__name__: f for f in (calib_verdict, calib_report, calib_diversity, reject_histogram, calib_sufficiency, reproj_rms, seen_by_both, outlier_3sigma, percentiles, dsm_checks, height_stats, terrain_describe, terrain_extents, image_sharpness, terrain_sample, terrain_fallback, locate_ladder, ray_hits, heading_residual, gps_centroid, align_error)}
QUERIES |= {"ray_first_crossing": _march("a"), "ray_march_b": _march("b"), "ray_march_c": _march("c")}
