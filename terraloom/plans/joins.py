"""Queries that match: by time, by descriptor, by place and by order, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import matching, points
from terraloom.plans.views import HEIGHT, WIDTH, sql, view

c = F.col
#: Readings are dealt out by node and days.
BUCKET_US = 86_400_000_000
RATIO = 0.95


def nearest_imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.nearest_in_time(view(spark, sf_dir, "image"), view(spark, sf_dir, "imu").select("node", "ts_us", "event_id", "yaw"), "node", "ts_us", "event_id", BUCKET_US)
    return found.select("image_id", c("near.event_id").alias("event_id"), c("near.yaw").alias("yaw"), F.abs(c("near.ts_us") - c("ts_us")).alias("gap_us"))


def latest_imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.latest(view(spark, sf_dir, "imu"), "node", "event_id").select("node", "last.event_id", "last.tilt", "last.roll", "last.yaw")


def pair_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pair_band(view(spark, sf_dir, "obs"), "image_id")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = view(spark, sf_dir, "vec")
    queries = vec.select("image_id", c("vec_id").alias("q_id"), c("embedding").alias("qe"))
    base = vec.select("image_id", c("vec_id").alias("b_id"), c("embedding").alias("be"))
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    return matching.two_nearest(queries.withColumn("qe", wide("qe")), base.withColumn("be", wide("be")), "image_id", matching.squared_distance("qe", "be"))


def knn_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("q_id", "first", "second", F.round("d1", 5).alias("d1"), F.round("d2", 5).alias("d2"))


def knn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ratio_test(_nearest(spark, sf_dir), RATIO).select("q_id", "first", F.round("d1", 5).alias("d1"))


def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = view(spark, sf_dir, "obs").select((c("image_id") % 50).alias("tile"), "image_id", ((c("image_id") * 2654435761) % 65536).alias("bits"))
    queries = bits.where("image_id % 20 = 0").select("tile", c("image_id").alias("q_id"), c("bits").alias("q_code"))
    base = bits.select("tile", c("image_id").alias("b_id"), c("bits").alias("b_code"))
    return matching.two_nearest_codes(queries, base, "tile", 16).select("q_id", "first", "second", c("d1").cast("bigint").alias("d1"), c("d2").cast("bigint").alias("d2"))


def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = view(spark, sf_dir, "match").select(c("match_id").alias("click_id"), F.floor(c("img_a") / 100).alias("grp"), "u", "v")
    pts = view(spark, sf_dir, "obs").select(F.floor(c("image_id") / 100).alias("grp"), "pt_id", "pu", "pv")
    return matching.snap(clicks, pts, "grp", 30.0).select("click_id", "pt_id", F.round("dist", 6).alias("dist"))


def ray_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = view(spark, sf_dir, "ray").select("ray_id", F.floor(c("ray_id") / 50).alias("grp"), *_unit())
    pts = view(spark, sf_dir, "ray").select(F.floor(c("ray_id") / 50).alias("grp"), c("ray_id").alias("pt_id"), (c("e0") - 50).alias("x"), (c("n0") - 37).alias("y"), (c("z0") - 109).alias("z"))
    return matching.nearest_to_ray(rays, pts, "grp").select("ray_id", "pt_id", F.round("t", 6).alias("t"), F.round("d2", 6).alias("d2"))


def _unit() -> list:
    norm = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))
    return [F.when(norm > 0, c(k) / norm).otherwise(0.0).alias(f"d{k}") for k in "xyz"]


def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "match").groupBy("img_a", "img_b").agg(F.sum("inliers").alias("n"))
    best = pairs.groupBy("img_a").agg(F.max(F.struct("n", (-c("img_b")).alias("b"))).alias("m"))
    return best.select("img_a", (-c("m.b")).alias("img_b"), c("m.n").alias("n"))


def select_by_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.select_by_grid(view(spark, sf_dir, "match"), ["img_a"], ["match_id"], WIDTH, HEIGHT, 12).select("match_id", "img_a", "cell_col", "cell_row")


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.stride(view(spark, sf_dir, "match"), ["img_a"], ["match_id"], 3).select("match_id", "img_a")


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.label_by_order(view(spark, sf_dir, "gcp"), ["cam_id"], ["gcp_id"], "GCP").select("gcp_id", "label")


def ring_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "match").withColumn("g", F.floor(c("match_id") / 40))
    rings = rows.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("match_id", "u", "v"))), lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"))).alias("ring"))
    closed = rings.select("g", F.posexplode(points.close_ring(c("ring"))).alias("at", "p"))
    return closed.select(c("g").cast("bigint").alias("ring_id"), c("at").cast("bigint").alias("place"), "p.u", "p.v")


def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs").select("image_id", "gray")
    return matching.upsert(obs, obs.where("image_id % 3 = 0").withColumn("gray", c("gray") + 1000), "image_id")


def click_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = view(spark, sf_dir, "match").select("img_a", "match_id", F.when(c("match_id") % 3 == 0, "ortho").otherwise("field").alias("kind"), "u", "v")
    return matching.paired_clicks(clicks, "img_a", "match_id").drop("img_a")


def point_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, pts = view(spark, sf_dir, "obs"), view(spark, sf_dir, "match").select("match_id", c("img_a").alias("image_id"))
    seen = obs.where("NOT offscreen").groupBy("image_id").agg(F.avg("gray").alias("g"))
    return pts.join(seen, "image_id", "left").select("match_id", F.round(F.coalesce("g", F.lit(180.0)), 4).alias("gray"))


_IMU = sql("image", "imu") + ", r AS (SELECT node, ts_us, min(event_id) AS event_id FROM v_imu GROUP BY node, ts_us)"
_PAIRS = "(SELECT q.image_id, q.vec_id AS q_id, b.vec_id AS b_id, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM v_vec q JOIN v_vec b ON q.image_id = b.image_id AND q.vec_id <> b.vec_id)"
_TWO = sql("vec") + f", n AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, b_id) AS k FROM {_PAIRS}), t AS (SELECT a.q_id, a.b_id AS first, a.d AS d1, b.b_id AS second, b.d AS d2 FROM n a LEFT JOIN n b ON a.q_id = b.q_id AND b.k = 2 WHERE a.k = 1)"
ORACLE = {
    "nearest_imu": _IMU + ", p AS (SELECT i.image_id, i.ts_us, r.ts_us AS pt, r.event_id AS pe FROM v_image i ASOF LEFT JOIN r ON i.node = r.node AND i.ts_us >= r.ts_us), n AS (SELECT i.image_id, r.ts_us AS nt, r.event_id AS ne FROM v_image i ASOF LEFT JOIN r ON i.node = r.node AND i.ts_us <= r.ts_us), b AS (SELECT image_id, CASE WHEN pe IS NULL THEN ne WHEN ne IS NULL THEN pe WHEN nt - ts_us < ts_us - pt THEN ne WHEN nt - ts_us = ts_us - pt THEN least(ne, pe) ELSE pe END AS event_id, ts_us FROM p JOIN n USING (image_id)) SELECT image_id, b.event_id, yaw, abs(v_imu.ts_us - b.ts_us) AS gap_us FROM b LEFT JOIN v_imu ON b.event_id = v_imu.event_id",
    "latest_imu": sql("imu") + " SELECT node, max(event_id) AS event_id, arg_max(tilt, event_id) AS tilt, arg_max(roll, event_id) AS roll, arg_max(yaw, event_id) AS yaw FROM v_imu GROUP BY node",
    "pair_band": sql("obs") + " SELECT x.image_id AS a, y.image_id AS b FROM v_obs x JOIN v_obs y ON y.image_id BETWEEN x.image_id + 1 AND x.image_id + 7",
    "knn_two": _TWO + " SELECT q_id, first, second, round(d1, 5) AS d1, round(d2, 5) AS d2 FROM t",
    "knn_ratio": _TWO + f" SELECT q_id, first, round(d1, 5) AS d1 FROM t WHERE d1 < {RATIO}e0 * d2",
    "knn_hamming": sql("obs") + ", h AS (SELECT image_id % 50 AS tile, image_id, (image_id * 2654435761) % 65536 AS bits FROM v_obs), n AS (SELECT q.image_id AS q_id, b.image_id AS b_id, bit_count(xor(q.bits, b.bits))::BIGINT AS d FROM h q JOIN h b ON q.tile = b.tile AND q.image_id <> b.image_id WHERE q.image_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, b_id) AS k FROM n) SELECT a.q_id, a.b_id AS first, b.b_id AS second, a.d AS d1, b.d AS d2 FROM k a LEFT JOIN k b ON a.q_id = b.q_id AND b.k = 2 WHERE a.k = 1",
    "snap_nearest": sql("match", "obs") + ", n AS (SELECT match_id AS click_id, pt_id, sqrt((u-pu)*(u-pu) + (v-pv)*(v-pv)) AS dist FROM v_match JOIN v_obs ON floor(img_a/100) = floor(image_id/100)), m AS (SELECT click_id, arg_min(pt_id, (dist, pt_id)) AS pt_id, min(dist) AS dist FROM n WHERE dist <= 30 GROUP BY click_id) SELECT match_id AS click_id, pt_id, round(dist, 6) AS dist FROM v_match LEFT JOIN m ON match_id = click_id",
    "ray_nearest": sql("ray") + ", q AS (SELECT ray_id, floor(ray_id/50) AS grp, x/sqrt(x*x+y*y+z*z) AS dx, y/sqrt(x*x+y*y+z*z) AS dy, z/sqrt(x*x+y*y+z*z) AS dz, e0-50 AS px, n0-37 AS py, z0-109 AS pz, x*x+y*y+z*z > 0 AS ok FROM v_ray), d AS (SELECT ray_id, grp, CASE WHEN ok THEN dx ELSE 0 END AS dx, CASE WHEN ok THEN dy ELSE 0 END AS dy, CASE WHEN ok THEN dz ELSE 0 END AS dz FROM q), t AS (SELECT d.ray_id, p.ray_id AS pt_id, p.px*d.dx + p.py*d.dy + p.pz*d.dz AS t, p.px, p.py, p.pz, d.dx, d.dy, d.dz FROM d JOIN q p ON d.grp = p.grp), s AS (SELECT *, (px-t*dx)*(px-t*dx) + (py-t*dy)*(py-t*dy) + (pz-t*dz)*(pz-t*dz) AS d2 FROM t WHERE t >= 0) SELECT ray_id, arg_min(pt_id, (d2, pt_id)) AS pt_id, round(arg_min(t, (d2, pt_id)), 6) AS t, round(min(d2), 6) AS d2 FROM s WHERE d2 < 400 GROUP BY ray_id",
    "best_pair": sql("match") + ", p AS (SELECT img_a, img_b, sum(inliers)::BIGINT AS n FROM v_match GROUP BY 1, 2) SELECT img_a, arg_max(img_b, (n, -img_b)) AS img_b, max(n) AS n FROM p GROUP BY img_a",
    "select_by_grid": sql("match") + f", g AS (SELECT *, least(3, floor(u/{WIDTH / 4}e0))::INTEGER AS cell_col, least(2, floor(v/{HEIGHT / 3}e0))::INTEGER AS cell_row FROM v_match), f AS (SELECT *, row_number() OVER (PARTITION BY img_a, cell_col, cell_row ORDER BY match_id) AS k FROM g), h AS (SELECT *, row_number() OVER (PARTITION BY img_a ORDER BY match_id) AS j FROM f WHERE k = 1) SELECT match_id, img_a, cell_col, cell_row FROM h WHERE j <= 12",
    "stride_sample": sql("match") + ", k AS (SELECT *, row_number() OVER (PARTITION BY img_a ORDER BY match_id) AS k FROM v_match) SELECT match_id, img_a FROM k WHERE (k - 1) % 3 = 0",
    "order_labels": sql("gcp") + " SELECT gcp_id, concat('GCP', row_number() OVER (PARTITION BY cam_id ORDER BY gcp_id)) AS label FROM v_gcp",
    "ring_close": sql("match") + ", k AS (SELECT floor(match_id/40)::BIGINT AS ring_id, u, v, row_number() OVER (PARTITION BY floor(match_id/40) ORDER BY match_id) - 1 AS place, count(*) OVER (PARTITION BY floor(match_id/40)) AS n FROM v_match) SELECT ring_id, place, u, v FROM k UNION ALL SELECT ring_id, n, u, v FROM k WHERE place = 0",
    "feature_upsert": sql("obs") + " SELECT image_id, CASE WHEN image_id % 3 = 0 THEN gray + 1000 ELSE gray END AS gray FROM v_obs",
    "click_pairs": sql("match") + ", k AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'ortho' ELSE 'field' END AS kind, u, v, lag(CASE WHEN match_id % 3 = 0 THEN 'ortho' ELSE 'field' END) OVER w AS pk, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM v_match WINDOW w AS (PARTITION BY img_a ORDER BY match_id)) SELECT match_id, pu AS field_u, pv AS field_v, u AS ortho_u, v AS ortho_v FROM k WHERE kind = 'ortho' AND pk = 'field'",
    "point_colour": sql("obs", "match") + ", s AS (SELECT image_id, avg(gray) AS g FROM v_obs WHERE NOT offscreen GROUP BY 1) SELECT match_id, round(coalesce(g, 180), 4) AS gray FROM v_match LEFT JOIN s ON img_a = image_id",
}

QUERIES = {f.__name__: f for f in (nearest_imu, latest_imu, pair_band, knn_two, knn_ratio, knn_hamming, snap_nearest, ray_nearest, best_pair, select_by_grid, stride_sample, order_labels, ring_close, feature_upsert, click_pairs, point_colour)}
