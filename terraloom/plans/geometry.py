"""Queries of the camera geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import camera, geodesy
from terraloom.operators import points
from terraloom.plans import sqlgeo
from terraloom.plans.views import CX, CY, DISTORTION, FX, FY, HEIGHT, WIDTH, sql, view

c = F.col
K = (FX, FY, CX, CY)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", c("o_custkey").alias("cam_id"))
    return view(spark, sf_dir, "pixel_of_order").join(orders, c("l_orderkey") == c("o_orderkey")).select("cam_id", "u", "v")


def flat_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = camera.prepare_cameras(view(spark, sf_dir, "camera"))
    hits = camera.pixels_to_ground(_pixels(spark, sf_dir).join(cameras, "cam_id"), *K)
    return hits.select("cam_id", "u", "v", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def flat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = camera.prepare_cameras(view(spark, sf_dir, "camera"))
    hits = camera.grid_to_ground(cameras, "cam_id", WIDTH, HEIGHT, 100, *K)
    return hits.select("cam_id", c("u").cast("bigint").alias("pixel_x"), c("v").cast("bigint").alias("pixel_y"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def gsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "camera").select("cam_id", *(F.round(camera.ground_sample(c("height"), c("pitch"), f), 10).alias(n) for f, n in ((FX, "gsd_x"), (FY, "gsd_y"))))
    return df


def scale_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (800 + (c("cam_id") % 7) * 200).cast("double"), (600 + (c("cam_id") % 5) * 150).cast("double")
    pairs = zip(("fx", "fy", "cx", "cy"), K, (w, h, w, h), (WIDTH, HEIGHT, WIDTH, HEIGHT))
    return view(spark, sf_dir, "camera").select("cam_id", *(F.round(camera.scaled(k, size, float(of)), 8).alias(n) for n, k, size, of in pairs))


def nominal_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (640 + (c("cam_id") % 9) * 160).cast("double"), (480 + (c("cam_id") % 6) * 120).cast("double")
    f = camera.nominal_focal
    return view(spark, sf_dir, "camera").select("cam_id", F.round(f(w, 3.68, 3.6), 8).alias("fx_sensor"), F.round(f(h, 2.76, 3.6), 8).alias("fy_sensor"), F.round(2000 * w / 2592, 8).alias("fx_terrain"), F.round(f(w, 4.614, 4.44), 8).alias("fx_phone"), (w / 2).alias("cx"), (h / 2).alias("cy"))


def gcp_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = camera.prepare_cameras(view(spark, sf_dir, "camera"))
    known = view(spark, sf_dir, "gcp").withColumnsRenamed({"lat": "known_lat", "lon": "known_lon", "pixel_u": "u", "pixel_v": "v"})
    df = points.residuals(camera.pixels_to_ground(known.join(cameras, "cam_id"), *K))
    return df.select("gcp_id", (F.round("err_lat", 7) + 0.0).alias("err_lat"), (F.round("err_lon", 7) + 0.0).alias("err_lon"), F.round("err_m", 3).alias("err_m"))


def gcp_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = camera.prepare_cameras(view(spark, sf_dir, "camera"))
    known = view(spark, sf_dir, "gcp").withColumnsRenamed({"lat": "known_lat", "lon": "known_lon", "pixel_u": "u", "pixel_v": "v"})
    hit = camera.pixels_to_ground(known.join(cameras, "cam_id"), *K).select("cam_id", "cam_lat", (c("lat") - c("known_lat")).alias("a"), (c("lon") - c("known_lon")).alias("b"))
    off = lambda x: F.coalesce(c(x), F.lit(points.MISS_DEGREES))
    told = hit.groupBy("cam_id").agg(F.count("a").alias("hits"), F.count("*").alias("n"), F.sum(F.pow(off("a"), 2.0)).alias("a2"), F.sum(F.pow(off("b"), 2.0)).alias("b2"), F.first("cam_lat").alias("cam_lat"))
    rms = F.sqrt((c("a2") + c("b2")) / c("n") / 2)
    return told.select("cam_id", "hits", (c("n") - c("hits")).alias("misses"), F.round(rms, 7).alias("rms_deg"), F.round(rms * 111320 * F.cos(F.radians("cam_lat")), 2).alias("rms_m"))


def aoi_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points.aoi_ring(view(spark, sf_dir, "camera"), "cam_lat", "cam_lon", 500.0)
    return df.select("cam_id", F.posexplode("ring").alias("vertex", "at")).select("cam_id", c("vertex").cast("bigint").alias("vertex"), F.round(c("at")[0], 7).alias("lon"), F.round(c("at")[1], 7).alias("lat"))


def undistort(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = camera.undistort_point(view(spark, sf_dir, "gcp"), "pixel_u", "pixel_v", *K, d=DISTORTION)
    return df.select("gcp_id", F.round("und_u", 5).alias("und_u"), F.round("und_v", 5).alias("und_v"))


def max_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how far points move; with fractions of pixels, which are not cut off first."""
    df = camera.undistort_point(view(spark, sf_dir, "gcp"), "pixel_u", "pixel_v", *K, d=DISTORTION)
    moved = F.hypot(c("und_u") - c("pixel_u"), c("und_v") - c("pixel_v"))
    return df.withColumn("moved", moved).groupBy("cam_id").agg(F.round(F.max("moved"), 4).alias("max_px"), F.max_by("gcp_id", F.struct(F.round("moved", 6), -c("gcp_id"))).alias("worst"))


def project_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "point").select(c("x"), c("y"), (c("x") - 40).alias("px"), (c("y") - 30).alias("py"), (c("z") - 101).alias("pz")).distinct()
    df = camera.project_point(df, "px", "py", "pz", *K, width=WIDTH, height=HEIGHT)
    return df.groupBy("inside").agg(F.count("*").alias("n"), F.round(F.avg("u"), 3).alias("mean_u"), F.round(F.avg("v"), 3).alias("mean_v"))


def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = geodesy.utm(view(spark, sf_dir, "camera"), "cam_lat", "cam_lon", 18)
    return df.select("cam_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def sphere_and_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "camera")
    lat, lon = geodesy.enu_to_latlon_sphere(c("heading"), c("pitch"), c("cam_lat"), c("cam_lon"))
    df = df.withColumns({"lat": lat, "lon": lon})
    return df.select("cam_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round(geodesy.haversine_m(c("cam_lat"), c("cam_lon"), c("lat"), c("lon")), 3).alias("metres"))


def plane_hit_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "camera").select("cam_id", F.radians("heading").alias("yaw"), F.radians("pitch").alias("pitch"), F.radians("roll").alias("roll"), F.lit(10.0).alias("cam_x"), F.lit(20.0).alias("cam_y"), c("height").alias("cam_z"), ((c("cam_id") % 21 - 10) / 20).alias("ray_x"), ((c("cam_id") % 17 - 8) / 20).alias("ray_y"), F.lit(1.0).alias("ray_z"))
    df = camera.plane_hit_euler(df, 0.0)
    return df.select("cam_id", F.round("hit_x", 5).alias("hit_x"), F.round("hit_y", 5).alias("hit_y"))


def similarity_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = [0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0]
    df = points.apply_similarity(view(spark, sf_dir, "pose").withColumnRenamed("alt", "z"), 1.5, r, [10.0, -20.0, 5.0])
    df = geodesy.enu_to_latlon(df.withColumns({"lat0": F.lit(43.05), "lon0": F.lit(-76.12)}), "sx", "sy", "lat0", "lon0")
    return df.select("pose_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("sz", 4).alias("alt"))


_PIXELS = "px AS (SELECT o_custkey AS cam_id, u, v FROM v_pixel_of_order JOIN orders ON l_orderkey = o_orderkey)"


def _undistort_sql() -> str:
    k1, k2, p1, p2, k3 = (f"({x!r}::DOUBLE)" for x in DISTORTION)
    steps = [f"(pixel_u - {CX!r}::DOUBLE)/{FX!r}::DOUBLE AS x0, (pixel_v - {CY!r}::DOUBLE)/{FY!r}::DOUBLE AS y0", "x0 AS xa0, y0 AS ya0"]
    for k in range(5):
        r2 = f"(xa{k}*xa{k} + ya{k}*ya{k})"
        rad = f"(1 + {r2}*({k1} + {r2}*({k2} + {r2}*{k3})))"
        steps.append(f"(x0 - (2*{p1}*xa{k}*ya{k} + {p2}*({r2} + 2*xa{k}*xa{k})))/{rad} AS xa{k + 1}, (y0 - ({p1}*({r2} + 2*ya{k}*ya{k}) + 2*{p2}*xa{k}*ya{k}))/{rad} AS ya{k + 1}")
    steps.append(f"xa5*{FX!r}::DOUBLE + {CX!r}::DOUBLE AS und_u, ya5*{FY!r}::DOUBLE + {CY!r}::DOUBLE AS und_v")
    return sql("gcp") + ",\n" + sqlgeo.chain("und", "v_gcp", steps)


def _gcp_hits() -> str:
    return sql("camera", "gcp") + ",\n" + sqlgeo.rotation("rot", "v_camera") + ",\nj AS (SELECT rot.*, gcp_id, lat AS known_lat, lon AS known_lon, pixel_u AS u, pixel_v AS v FROM rot JOIN v_gcp USING (cam_id)),\n" + sqlgeo.ray("ry", "j", *K) + ",\n" + sqlgeo.direct("hit", "ry")


def _utm_sql() -> str:
    n = geodesy.FLAT / (2 - geodesy.FLAT)
    radius = geodesy.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = 2 * n**0.5 / (1 + n)
    xi = "xi" + "".join(f" + {a!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    eta = "eta" + "".join(f" + {a!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    steps = ["sin(radians(cam_lat)) AS sp, radians(cam_lon - (-75)) AS dl", f"sinh(atanh(sp) - {e!r}::DOUBLE*atanh({e!r}::DOUBLE*sp)) AS t", "atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1 + t*t)) AS eta"]
    return sql("camera") + ",\n" + sqlgeo.chain("q", "v_camera", steps) + f"\nSELECT cam_id, round(500000 + 0.9996::DOUBLE*{radius!r}::DOUBLE*({eta}), 4) AS x, round(0.9996::DOUBLE*{radius!r}::DOUBLE*({xi}), 4) AS y FROM q"


ORACLE = {
    "flat_project": sql("camera", "pixel_of_order") + f",\n{_PIXELS},\n" + sqlgeo.rotation("rot", "v_camera") + ",\nj AS (SELECT rot.*, u, v FROM px JOIN rot USING (cam_id)),\n" + sqlgeo.ray("ry", "j", *K) + ",\n" + sqlgeo.direct("hit", "ry") + "\nSELECT cam_id, u, v, round(lat, 7) AS lat, round(lon, 7) AS lon FROM hit",
    "flat_grid": sql("camera") + ",\n" + sqlgeo.rotation("rot", "v_camera") + f",\nj AS (SELECT rot.*, px::DOUBLE AS u, py::DOUBLE AS v FROM rot, range(0, {WIDTH}, 100) a(px), range(0, {HEIGHT}, 100) b(py)),\n" + sqlgeo.ray("ry", "j", *K) + ",\n" + sqlgeo.direct("hit", "ry") + "\nSELECT cam_id, u::BIGINT AS pixel_x, v::BIGINT AS pixel_y, round(lat, 7) AS lat, round(lon, 7) AS lon FROM hit WHERE lat IS NOT NULL",
    "gsd": sql("camera") + f" SELECT cam_id, round(height/sin(abs(radians(pitch)))/{FX!r}::DOUBLE, 10) AS gsd_x, round(height/sin(abs(radians(pitch)))/{FY!r}::DOUBLE, 10) AS gsd_y FROM v_camera",
    "scale_k": sql("camera") + f", s AS (SELECT cam_id, (800 + (cam_id % 7) * 200)::DOUBLE AS w, (600 + (cam_id % 5) * 150)::DOUBLE AS h FROM v_camera) SELECT cam_id, round({FX!r}::DOUBLE*w/{WIDTH}::DOUBLE, 8) AS fx, round({FY!r}::DOUBLE*h/{HEIGHT}::DOUBLE, 8) AS fy, round({CX!r}::DOUBLE*w/{WIDTH}::DOUBLE, 8) AS cx, round({CY!r}::DOUBLE*h/{HEIGHT}::DOUBLE, 8) AS cy FROM s",
    "nominal_k": sql("camera") + ", s AS (SELECT cam_id, (640 + (cam_id % 9) * 160)::DOUBLE AS w, (480 + (cam_id % 6) * 120)::DOUBLE AS h FROM v_camera) SELECT cam_id, round(3.6e0/3.68e0*w, 8) AS fx_sensor, round(3.6e0/2.76e0*h, 8) AS fy_sensor, round(2000*w/2592, 8) AS fx_terrain, round(4.44e0/4.614e0*w, 8) AS fx_phone, w/2 AS cx, h/2 AS cy FROM s",
    "gcp_residuals": _gcp_hits() + ",\n" + sqlgeo.inverse("ik", "hit", "known_lat", "known_lon", "cam_lat", "cam_lon", "ke", "kn") + ",\n" + sqlgeo.inverse("ip", "ik", "lat", "lon", "cam_lat", "cam_lon", "pe", "pn2") + "\nSELECT gcp_id, round(coalesce(lat - known_lat, 'nan'::DOUBLE), 7) + 0.0e0 AS err_lat, round(coalesce(lon - known_lon, 'nan'::DOUBLE), 7) + 0.0e0 AS err_lon, round(coalesce(sqrt((pe-ke)*(pe-ke) + (pn2-kn)*(pn2-kn)), 'nan'::DOUBLE), 3) AS err_m FROM ip",
    "gcp_rms": _gcp_hits() + ",\np AS MATERIALIZED (SELECT cam_id, cam_lat, lat, lon, known_lat, known_lon FROM hit),\no AS MATERIALIZED (SELECT cam_id, cam_lat, lat, coalesce(lat - known_lat, 100e0) AS a, coalesce(lon - known_lon, 100e0) AS b FROM p)\nSELECT cam_id, count(lat) AS hits, count(*) - count(lat) AS misses, round(sqrt(avg(a*a + b*b)/2), 7) AS rms_deg, round(sqrt(avg(a*a + b*b)/2)*111320*cos(radians(any_value(cam_lat))), 2) AS rms_m FROM o GROUP BY cam_id",
    "aoi_box": sql("camera") + ", b AS (SELECT cam_id, cam_lat, cam_lon, 500e0/111320 AS dlat, 500e0/(111320*cos(radians(cam_lat))) AS dlon FROM v_camera) SELECT cam_id, vertex::BIGINT AS vertex, round(cam_lon + dlon*(CASE WHEN vertex IN (1, 2) THEN 1 ELSE -1 END), 7) AS lon, round(cam_lat + dlat*(CASE WHEN vertex IN (2, 3) THEN 1 ELSE -1 END), 7) AS lat FROM b, range(5) r(vertex)",
    "undistort": _undistort_sql() + "\nSELECT gcp_id, round(und_u, 5) AS und_u, round(und_v, 5) AS und_v FROM und",
    "max_displacement": _undistort_sql() + ",\nm AS (SELECT *, sqrt((und_u-pixel_u)*(und_u-pixel_u) + (und_v-pixel_v)*(und_v-pixel_v)) AS moved FROM und)\nSELECT cam_id, round(max(moved), 4) AS max_px, first(gcp_id ORDER BY round(moved, 6) DESC, gcp_id) AS worst FROM m GROUP BY cam_id",
    "project_to_image": sql("point") + f", d AS (SELECT DISTINCT x, y, z FROM v_point), q AS (SELECT CASE WHEN z-101 > 0 THEN (x-40)/(z-101)*{FX!r}::DOUBLE + {CX!r}::DOUBLE END AS u, CASE WHEN z-101 > 0 THEN (y-30)/(z-101)*{FY!r}::DOUBLE + {CY!r}::DOUBLE END AS v FROM d), i AS (SELECT *, coalesce(u >= 0 AND u < {WIDTH} AND v >= 0 AND v < {HEIGHT}, false) AS inside FROM q) SELECT inside, count(*) AS n, round(avg(u), 3) AS mean_u, round(avg(v), 3) AS mean_v FROM i GROUP BY inside",
    "utm_forward": _utm_sql(),
    "sphere_and_haversine": sql("camera") + ", q AS (SELECT *, cam_lat + degrees(pitch/6371000e0) AS lat, cam_lon + degrees(heading/(6371000e0*cos(radians(cam_lat)))) AS lon FROM v_camera), h AS (SELECT *, pow(sin(radians(lat-cam_lat)/2), 2) + cos(radians(cam_lat))*cos(radians(lat))*pow(sin(radians(lon-cam_lon)/2), 2) AS h FROM q) SELECT cam_id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(2*6371000e0*asin(sqrt(least(1e0, h))), 3) AS metres FROM h",
    "plane_hit_euler": sql("camera") + ", q AS (SELECT cam_id, height, radians(heading) AS a, radians(pitch) AS b, radians(roll) AS r, (cam_id % 21 - 10)/20e0 AS x, (cam_id % 17 - 8)/20e0 AS y, 1e0 AS z FROM v_camera), w AS (SELECT *, cos(a)*cos(b)*x + (cos(a)*sin(b)*sin(r) - sin(a)*cos(r))*y + (cos(a)*sin(b)*cos(r) + sin(a)*sin(r))*z AS wx, sin(a)*cos(b)*x + (sin(a)*sin(b)*sin(r) + cos(a)*cos(r))*y + (sin(a)*sin(b)*cos(r) - cos(a)*sin(r))*z AS wy, -sin(b)*x + cos(b)*sin(r)*y + cos(b)*cos(r)*z AS wz FROM q), t AS (SELECT *, CASE WHEN abs(wz) >= 1e-6 AND -height/wz > 0 THEN -height/wz END AS t FROM w) SELECT cam_id, round(10 + t*wx, 5) AS hit_x, round(20 + t*wy, 5) AS hit_y FROM t",
    "similarity_apply": sql("pose") + ", s AS (SELECT pose_id, 1.5e0*(0.8e0*x - 0.6e0*y) + 10 AS sx, 1.5e0*(0.6e0*x + 0.8e0*y) - 20 AS sy, 1.5e0*alt + 5 AS sz, 43.05e0 AS lat0, -76.12e0 AS lon0 FROM v_pose),\n" + sqlgeo.direct("hit", "s", "sx", "sy", "lat0", "lon0") + "\nSELECT pose_id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(sz, 4) AS alt FROM hit",
}

QUERIES = {f.__name__: f for f in (flat_project, flat_grid, gsd, scale_k, nominal_k, gcp_residuals, gcp_rms, aoi_box, undistort, max_displacement, project_to_image, utm_forward, sphere_and_haversine, plane_hit_euler, similarity_apply)}
