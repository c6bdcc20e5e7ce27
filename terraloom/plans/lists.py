"""Queries over listings, texts, dates and datums, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import datum, frames, scalars
from terraloom.operators import listing
from terraloom.plans.views import sql, view

c = F.col
BOX = "43.01,43.05, -76.06,-76.02"
AFFINE = (0.5, 0.0, -10.0, 0.0, -0.25, 60.0)


def pole_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pole").select("pole_id", listing.is_city_owned([c("pole_type"), c("owner")]).alias("city_owned"))


def poles_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    poles = view(spark, sf_dir, "pole").withColumn("b", listing.parse_box(F.lit(BOX)))
    return poles.where(listing.in_box(c("lat"), c("lon"), c("b.lat_min"), c("b.lat_max"), c("b.lon_min"), c("b.lon_max"))).select("pole_id")


def box_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = view(spark, sf_dir, "pole").select("pole_id", F.when(c("pole_id") % 4 == 0, "1,2,x,4").when(c("pole_id") % 4 == 1, "1,2,3").otherwise(F.concat_ws(",", F.lit("1.5"), c("pole_id").cast("string"), F.lit(" 3"), F.lit("4.25"))).alias("box"))
    return boxes.select("pole_id", listing.box_predicate(c("box")).alias("predicate"))


def pole_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.first_of_each(view(spark, sf_dir, "pole"), "asset", "pole_id").select("asset", "pole_id", "name")


def pole_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.map_from_arrays(F.array(F.lit("lat"), F.lit("lng"), F.lit("x")), F.array(c("lat").cast("string"), c("lon").cast("string"), F.lit("1")))
    df = view(spark, sf_dir, "pole").withColumn("at", listing.probe_position(row))
    made = df.select("pole_id", listing.feature(c("at.lon"), c("at.lat"), F.struct("pole_id", "name")).alias("f"))
    json = F.from_json("f", "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties STRUCT<pole_id: BIGINT, name: STRING>")
    told = made.withColumn("j", json)
    return told.select("pole_id", "j.type", c("j.geometry.type").alias("geometry"), F.round(c("j.geometry.coordinates")[0], 6).alias("lon"), F.round(c("j.geometry.coordinates")[1], 6).alias("lat"), "j.properties.name")


def scene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.to_timestamp_ntz(F.lit("1996-06-15 00:00:00"))
    start, end = (taken + F.make_dt_interval(F.lit(d)) for d in (-30, 30))
    scenes = view(spark, sf_dir, "scene").withColumn("acquired", c("acquired").cast("timestamp_ntz"))
    return listing.scenes_between(scenes, start, end).select("id", "cloud_cover")


def scene_first_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = view(spark, sf_dir, "scene").withColumn("acquired", c("acquired").cast("timestamp_ntz"))
    return listing.scenes_between(scenes, F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), 0.5, 10).select("id", "cloud_cover")


def lwir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.visible_images(view(spark, sf_dir, "file").select("path")).select("path", listing.file_stem(c("path")).alias("stem"), listing.file_suffix(c("path")).alias("suffix"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "file").withColumn("name", F.element_at(F.split("path", "/"), -1))
    return listing.unique_names(files, "name", "file_id").select("file_id", "unique")


def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.folder_counts(view(spark, sf_dir, "file"))


def topk_opacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.top_by(view(spark, sf_dir, "splat").groupBy("splat_id").agg(F.max("opacity").alias("opacity")), "opacity", "splat_id", 300, 0.05)


def mode_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "ray").select(F.floor(c("ray_id") / 5).alias("grp"), F.when(c("ray_id") % 4 == 0, "terrain").when(c("ray_id") % 3 == 0, "3D").otherwise("flat").alias("mode"))
    return listing.modes(df, "grp", "mode").select(c("grp").cast("bigint").alias("grp"), "modes")


def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of either source once, those of both, and those of the first alone."""
    obs, pairs = view(spark, sf_dir, "obs").select(c("image_id").alias("id")), view(spark, sf_dir, "match").select(c("img_b").alias("id"))
    tag = lambda df, t: df.distinct().withColumn("of", F.lit(t))
    return tag(obs.union(pairs), "either").union(tag(obs.intersect(pairs), "both")).union(tag(obs.exceptAll(pairs.distinct()), "first"))


def appended_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, "obs").select("pt_id", "gray")
    new = view(spark, sf_dir, "match").select(c("match_id").alias("pt_id"), c("kp_a").alias("gray"))
    return listing.appended(old, new, "pt_id")


def present_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.when(c("pole_id") % 2 == 0, F.create_map(F.lit("owner"), c("owner"))).otherwise(F.create_map(F.lit("pole_type"), c("pole_type")))
    return listing.fields_present(view(spark, sf_dir, "pole").withColumn("row", row), "row", ["owner", "pole_type", "light_type"])


def imu_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "comment").withColumn("o", scalars.parse_orientation(c("comment"))).select("event_id", "o.roll", "o.pitch", "o.yaw")


def sensor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "reading").withColumn("s", scalars.status_bits(c("status").cast("int")))
    v = scalars.signed_16(c("lo"), c("hi"))
    return df.select("event_id", (v / 16).alias("heading"), (v / 16384).alias("quaternion"), *(c(f"s.{k}").cast("bigint").alias(k) for k in ("sys", "gyro", "accel", "mag")), scalars.is_yes(c("answer")).alias("yes"))


def dms_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "reading").withColumn("value", scalars.dms_to_degrees(c("deg"), c("mins"), c("secs"), c("hemi")))
    back = scalars.degrees_to_dms(c("value") + 1e-9 * F.signum("value"), 1)
    return df.withColumn("b", back).select("event_id", F.round("value", 9).alias("value"), c("b.degrees").cast("bigint").alias("d"), c("b.minutes").cast("bigint").alias("m"), c("b.seconds").cast("bigint").alias("s"))


def calibration_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "reading").groupBy("node").agg(F.min("ts_us").alias("t"))
    days = scalars.whole_days(c("t"), F.lit(1_720_000_000_000_000))
    return df.select("node", days.cast("bigint").alias("days"), (days > 180).alias("old"))


def datum_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("cam_id")
    df = view(spark, sf_dir, "camera").select("cam_id", F.when(k % 5 == 0, "GEOGCRS EGM96 height").when(k % 5 == 1, "COMPD EPSG 3855").when(k % 5 == 2, "NAVD88 (ft)").when(k % 5 == 3, None).otherwise("WGS 84").alias("wkt"), F.when(k % 3 == 0, "exif").when(k % 3 == 1, "user").otherwise("dem_plus_height").alias("source"), F.when(k % 7 != 0, c("height")).alias("elev"), F.when(k % 4 == 0, "egm96").alias("own"), (k % 11 == 0).alias("agl"))
    df = df.withColumn("terrain", datum.infer(c("wkt")))
    mixed = datum.mismatch(c("source"), c("elev"), F.coalesce("terrain", F.lit(datum.ELLIPSOID)), c("own"), c("agl"))
    return df.withColumn("mixed", mixed).select("cam_id", "terrain", "mixed", datum.warning(c("mixed"), F.coalesce("terrain", F.lit(datum.ELLIPSOID))).alias("warning"))


def datum_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("cam_id")
    df = view(spark, sf_dir, "camera").select("cam_id", c("cam_lat").alias("lat"), c("cam_lon").alias("lon"), "height", F.when(k % 3 == 0, "ellipsoid").otherwise("egm96").alias("from_datum"), F.when(k % 4 == 0, "egm96").when(k % 4 == 1, "navd88").otherwise("ellipsoid").alias("to_datum"))
    geoid = spark.createDataFrame([("egm96", 43, -77, -34.5)], "datum string, lat_cell long, lon_cell long, offset double")
    return datum.move(df, geoid, "height", "from_datum", "to_datum").select("cam_id", "moved", "moved_ok")


def affine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = frames.pixel_to_map(c("u"), c("v"), AFFINE)
    df = view(spark, sf_dir, "match").select("match_id", x.alias("x"), y.alias("y"))
    down, cut = frames.map_to_pixel(c("x") - 0.3, c("y"), AFFINE), frames.map_to_pixel(c("x") - 0.3, c("y"), AFFINE, truncate=True)
    return df.select("match_id", "x", "y", down[0].cast("bigint").alias("col"), cut[0].alias("col_cut"), down[1].cast("bigint").alias("row"))


def camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = [[F.lit(v) for v in row] for row in ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0))]
    df = view(spark, sf_dir, "pose")
    centre = frames.camera_centre(turn, [c("x"), c("y"), c("alt")])
    up = frames.to_y_up(c("x"), c("y"), c("alt"))
    moved = frames.local_to_map(c("x"), c("y"), c("alt"), (10.0, -20.0, 5.0))
    told = frames.ray_diagnostics(c("x"), c("y"), c("alt"), scalars.slant(c("x"), c("y"), c("alt")) + 1)
    near = lambda v: F.round(v, 6) + 0.0  # noqa: E731  no negative zero
    return df.select("pose_id", *(near(v).alias(f"{n}{k}") for n, vs in (("c", centre), ("v", up), ("m", moved)) for k, v in enumerate(vs)), near(told["horizontal"]).alias("horizontal"), near(told["off"]).alias("off"))


def board_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "match").groupBy("img_a").agg(F.sort_array(F.collect_list(F.struct("match_id", "u", "v"))).alias("p"))
    g = frames.board_geometry(F.transform("p", lambda p: p["u"]), F.transform("p", lambda p: p["v"]), 2592.0, 1944.0)
    return rows.withColumn("g", g).select("img_a", *(F.round(f"g.{k}", 6).alias(k) for k in ("coverage", "tilt", "centre_x", "centre_y")))


def height_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scalars.height_colour(c("alt"), F.lit(102.0), F.lit(6.9))
    return view(spark, sf_dir, "pose").withColumn("k", k).select("pose_id", *(F.round(f"k.{x}", 6).alias(x) for x in "rgb"), F.round(scalars.grey(c("x"), c("y"), c("alt")), 6).alias("grey"))


_HAS = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
_TOLD = lambda x: f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN {_HAS(x, listing.SHARED)} THEN false WHEN {_HAS(x, listing.CITY)} THEN true END"
_NUM = r"(-?\d+(?:\.\d+)?)"
_PATTERN = rf"(?i)roll\s+{_NUM}\s+pitch\s+{_NUM}\s+yaw\s+{_NUM}"
_PATH_OK = "NOT regexp_matches(path, '(^|/)\\.[^/]') AND NOT (" + " OR ".join(f"contains(lower(regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1)), '{w}')" for w in listing.HEAT) + ")"
ORACLE = {
    "pole_ownership": sql("pole") + f" SELECT pole_id, coalesce({_TOLD('pole_type')}, {_TOLD('owner')}, true) AS city_owned FROM v_pole",
    "poles_bbox": sql("pole") + " SELECT pole_id FROM v_pole WHERE (lat IS NULL OR lat BETWEEN 43.01e0 AND 43.05e0) AND lon BETWEEN -76.06e0 AND -76.02e0",
    "box_filters": sql("pole") + " SELECT pole_id, CASE WHEN pole_id % 4 >= 2 THEN concat('within_box(location, ', pole_id::DOUBLE, ', 3.0, 1.5, 4.25)') END AS predicate FROM v_pole",
    "pole_dedup": sql("pole") + " SELECT asset, min(pole_id) AS pole_id, arg_min(name, pole_id) AS name FROM v_pole GROUP BY asset",
    "pole_geojson": sql("pole") + " SELECT pole_id, 'Feature' AS type, CASE WHEN lat IS NOT NULL THEN 'Point' END AS geometry, CASE WHEN lat IS NOT NULL THEN round(lon, 6) END AS lon, round(lat, 6) AS lat, name FROM v_pole",
    "scene_filter": sql("scene") + " SELECT id, cloud_cover FROM v_scene WHERE acquired BETWEEN TIMESTAMP '1996-05-16' AND TIMESTAMP '1996-07-15' AND cloud_cover <= 0.20e0",
    "scene_first_ten": sql("scene") + " SELECT id, cloud_cover FROM v_scene WHERE acquired BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-01-01' AND cloud_cover <= 0.5e0 ORDER BY acquired, id LIMIT 10",
    "lwir_filter": sql("file") + f" SELECT DISTINCT path, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS suffix FROM v_file WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.jpg', '.jpeg', '.png') AND {_PATH_OK}",
    "unique_names": sql("file") + ", n AS (SELECT file_id, list_extract(string_split(path, '/'), -1) AS name FROM v_file), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id) - 1 AS k FROM n) SELECT file_id, CASE WHEN k = 0 THEN name ELSE concat(string_split(name, '.')[1], '_', k, '.', string_split(name, '.')[2]) END AS unique FROM k",
    "folder_counts": sql("file") + ", p AS (SELECT string_split(path, '/') AS p FROM v_file) SELECT p[1] AS folder, count(*) FILTER (len(p) = 2) AS here, count(*) FILTER (len(p) > 2) AS deeper FROM p WHERE len(p) > 1 GROUP BY 1",
    "topk_opacity": sql("splat") + " SELECT splat_id, max(opacity) AS opacity FROM v_splat GROUP BY 1 HAVING max(opacity) >= 0.05e0 ORDER BY 2 DESC, 1 LIMIT 300",
    "mode_set": sql("ray") + " SELECT floor(ray_id / 5)::BIGINT AS grp, string_agg(DISTINCT m, '+' ORDER BY m) AS modes FROM (SELECT ray_id, CASE WHEN ray_id % 4 = 0 THEN 'terrain' WHEN ray_id % 3 = 0 THEN '3D' ELSE 'flat' END AS m FROM v_ray) GROUP BY 1",
    "source_sets": sql("obs", "match") + ", a AS (SELECT image_id AS id FROM v_obs), b AS (SELECT img_b AS id FROM v_match) (SELECT id, 'either' AS of FROM (SELECT id FROM a UNION SELECT id FROM b)) UNION ALL (SELECT id, 'both' FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) UNION ALL (SELECT id, 'first' FROM (SELECT id FROM a EXCEPT SELECT id FROM b))",
    "appended_points": sql("obs", "match") + " SELECT pt_id, gray FROM v_obs UNION ALL SELECT match_id + (SELECT max(pt_id) + 1 FROM v_obs), kp_a FROM v_match",
    "present_fields": "SELECT count(*) > 0 AS owner, count(*) > 1 AS pole_type, false AS light_type FROM part",
    "imu_parse": sql("comment") + "".join([", p AS (SELECT event_id", *(f", TRY_CAST(nullif(regexp_extract(comment, '{_PATTERN}', {i}), '') AS DOUBLE) AS {n}" for i, n in enumerate(("roll", "pitch", "yaw"), 1)), " FROM v_comment) SELECT * FROM p"]),
    "sensor_decode": sql("reading") + ", v AS (SELECT *, CASE WHEN lo + hi*256 >= 32768 THEN lo + hi*256 - 65536 ELSE lo + hi*256 END AS v FROM v_reading) SELECT event_id, v/16e0 AS heading, v/16384e0 AS quaternion, status // 64 AS sys, status // 16 % 4 AS gyro, status // 4 % 4 AS accel, status % 4 AS mag, coalesce(lower(trim(answer)) IN ('y', 'yes', '1', 'true'), false) AS yes FROM v",
    "dms_convert": sql("reading") + ", v AS (SELECT event_id, (deg + mins/60e0 + secs/3600e0) * CASE WHEN upper(hemi) IN ('S', 'W') THEN -1 ELSE 1 END AS value, deg, mins, secs FROM v_reading) SELECT event_id, round(value, 9) AS value, deg AS d, mins AS m, secs AS s FROM v",
    "calibration_age": sql("reading") + ", a AS (SELECT node, ((1720000000000000 - min(ts_us)) // 86400000000)::BIGINT AS days FROM v_reading GROUP BY node) SELECT node, days, days > 180 AS old FROM a",
    "datum_rules": sql("camera") + ", t AS (SELECT cam_id, cam_id AS k, CASE cam_id % 5 WHEN 0 THEN 'egm96' WHEN 1 THEN 'egm2008' WHEN 2 THEN 'navd88' END AS terrain FROM v_camera), m AS (SELECT *, coalesce(terrain, 'ellipsoid') AS tt, CASE WHEN k % 4 = 0 THEN 'egm96' ELSE 'ellipsoid' END AS own FROM t), w AS (SELECT *, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k % 3 <> 2 AND own <> tt THEN own END AS mixed FROM m) SELECT cam_id, terrain, mixed, CASE WHEN mixed IS NOT NULL THEN concat('camera elevation in ', mixed, ' but terrain in ', tt) END AS warning FROM w",
    "datum_move": sql("camera") + ", o AS (SELECT cam_id, height, CASE WHEN cam_id % 3 = 0 THEN 'ellipsoid' ELSE 'egm96' END AS f, CASE cam_id % 4 WHEN 0 THEN 'egm96' WHEN 1 THEN 'navd88' ELSE 'ellipsoid' END AS t, floor(cam_lat) = 43 AND floor(cam_lon) = -77 AS known FROM v_camera), h AS (SELECT cam_id, height, f, t, CASE WHEN f = 'ellipsoid' THEN 0 WHEN f = 'egm96' AND known THEN -34.5e0 END AS df, CASE WHEN t = 'ellipsoid' THEN 0 WHEN t = 'egm96' AND known THEN -34.5e0 END AS dt FROM o), r AS (SELECT cam_id, height, CASE WHEN f = t THEN height ELSE height + df - dt END AS told FROM h) SELECT cam_id, coalesce(told, height) AS moved, told IS NOT NULL AS moved_ok FROM r",
    "affine_cells": sql("match") + ", p AS (SELECT match_id, 0.5e0*u + 0e0*v + -10e0 AS x, 0e0*u + -0.25e0*v + 60e0 AS y FROM v_match) SELECT match_id, x, y, floor((x - 0.3e0 + 10e0)/0.5e0)::BIGINT AS col, trunc((x - 0.3e0 + 10e0)/0.5e0)::BIGINT AS col_cut, floor((y - 60e0)/-0.25e0)::BIGINT AS row FROM p",
    "camera_frames": sql("pose") + " SELECT pose_id, round(-(0.8e0*x + 0.6e0*y + 0e0*alt), 6) + 0e0 AS c0, round(-(-0.6e0*x + 0.8e0*y + 0e0*alt), 6) + 0e0 AS c1, round(-(0e0*x + 0e0*y + alt), 6) + 0e0 AS c2, round(x, 6) + 0e0 AS v0, round(alt, 6) + 0e0 AS v1, round(-y, 6) + 0e0 AS v2, round(x - 10, 6) + 0e0 AS m0, round(y + 20, 6) + 0e0 AS m1, round(alt - 5, 6) + 0e0 AS m2, round(sqrt(x*x + y*y), 6) + 0e0 AS horizontal, round(abs(sqrt(x*x + y*y + alt*alt) - (sqrt(x*x + y*y + alt*alt) + 1)), 6) + 0e0 AS off FROM v_pose",
    "board_measures": sql("match") + ", g AS (SELECT img_a, (max(u) - min(u))*(max(v) - min(v))/(2592e0*1944e0) AS coverage, degrees(atan2(abs(arg_max(v, match_id) - arg_min(v, match_id)), abs(arg_max(u, match_id) - arg_min(u, match_id)))) AS a, avg(u)/2592 AS centre_x, avg(v)/1944 AS centre_y FROM v_match GROUP BY img_a) SELECT img_a, round(coverage, 6) AS coverage, round(least(a, 90 - a), 6) AS tilt, round(centre_x, 6) AS centre_x, round(centre_y, 6) AS centre_y FROM g",
    "height_colours": sql("pose") + ", t AS (SELECT *, greatest(0, least(1, (alt - 102)/6.9e0)) AS t FROM v_pose) SELECT pose_id, round(greatest(0, 1.5e0*t - 0.5e0), 6) AS r, round(greatest(0, sin(pi()*t)), 6) AS g, round(greatest(0, 1 - 1.5e0*t), 6) AS b, round(0.299e0*x + 0.587e0*y + 0.114e0*alt, 6) AS grey FROM t",
}

QUERIES = {f.__name__: f for f in (pole_ownership, poles_bbox, box_filters, pole_dedup, pole_geojson, scene_filter, scene_first_ten, lwir_filter, unique_names, folder_counts, topk_opacity, mode_set, source_sets, appended_points, present_fields, imu_parse, sensor_decode, dms_convert, calibration_age, datum_rules, datum_move, affine_cells, camera_frames, board_measures, height_colours)}
