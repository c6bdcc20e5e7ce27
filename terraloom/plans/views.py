"""Scenario tables derived from the star schema, the same in Spark and in DuckDB.

Each view is a table and a list of expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.session import tuned

#: The calibrated camera that the golden grid was made with.
FX, FY, CX, CY = 2944.738891849689, 2945.020052325181, 1271.277276119622, 932.8880659656849
WIDTH, HEIGHT = 2592, 1944
DISTORTION = [-0.4402040948058384, 0.26416390484297736, -0.00071150467839335, 0.00013960012128018417, -0.08296969936371298]

#: Microseconds of an event; SQL has another name for it.
MICROS, MICROS_SQL = "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"
#: The camera of a control point: five points each.
_CAM = "(1 + CAST(floor(p_partkey / 5) AS BIGINT))"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "camera": ("customer", ["c_custkey AS cam_id", "43 + (c_custkey % 1000) * 1e-4 AS cam_lat", "-76 - (c_custkey % 777) * 1e-4 AS cam_lon", "CAST(3 + c_custkey % 8 AS DOUBLE) AS height", "CAST((c_custkey * 37) % 360 AS DOUBLE) AS heading", "CAST(-(5 + c_custkey % 60) AS DOUBLE) AS pitch", "CAST(c_custkey % 11 - 5 AS DOUBLE) AS roll"]),
    "pixel_of_order": ("lineitem", ["l_orderkey", "CAST((l_partkey * 7) % 2592 AS DOUBLE) AS u", "CAST((l_suppkey * 13 + l_linenumber * 97) % 1944 AS DOUBLE) AS v"]),
    "imu": ("events", ["event_id", "CAST(user_id AS BIGINT) AS node", f"{MICROS} AS ts_us", "CAST(-(event_id % 90) AS DOUBLE) AS tilt", "CAST(event_id % 21 - 10 AS DOUBLE) AS roll", "CAST((event_id * 37) % 360 AS DOUBLE) AS yaw", "CAST(event_id % 4 AS BIGINT) AS calib_mag"]),
    "point": ("lineitem", ["(l_partkey % 400) * 0.25e0 + 0.1e0 AS x", "(l_suppkey * 7 % 300) * 0.25e0 + 0.1e0 AS y", "100 + l_quantity * 0.1e0 AS z"]),
    "pose": ("supplier", ["s_suppkey AS pose_id", "(s_suppkey * 17) % 110 - 0.25e0 AS x", "(s_suppkey * 23) % 90 + 0.25e0 AS y", "102 + (s_suppkey % 70) * 0.1e0 AS alt"]),
    "calib_img": ("part", ["p_partkey AS image_id", "p_retailprice / 9.3e0 AS sharpness", "CAST((p_partkey * 7) % 256 AS DOUBLE) AS brightness", "p_size / 55e0 AS coverage", "CAST((p_partkey * 3) % 46 AS DOUBLE) AS tilt_deg", "(p_partkey % 25) * 0.1e0 AS reproj_error", "p_partkey % 13 <> 0 AS corners_found", "(p_partkey * 31 % 1000) / 1000e0 AS board_x", "(p_partkey * 57 % 1000) / 1000e0 AS board_y", "CAST(p_partkey % 40 AS BIGINT) AS session_id"]),
    "gcp": ("part", ["p_partkey AS gcp_id", f"{_CAM} AS cam_id", "CAST((p_partkey * 101) % 2592 AS DOUBLE) AS pixel_u", "CAST(400 + (p_partkey * 53) % 1544 AS DOUBLE) AS pixel_v", f"43 + ({_CAM} % 1000) * 1e-4 + (p_partkey % 17) * 1e-5 AS lat", f"-76 - ({_CAM} % 777) * 1e-4 - (p_partkey % 19) * 1e-5 AS lon"]),
    "match": ("orders", ["o_orderkey AS match_id", "o_custkey AS img_a", "CAST(o_custkey + 1 + o_orderkey % 4 AS BIGINT) AS img_b", "CAST(o_orderkey % 13 AS BIGINT) AS kp_a", "CAST((o_orderkey * 7) % 13 AS BIGINT) AS kp_b", "CAST((o_orderkey * 7) % 2592 AS DOUBLE) AS u", "CAST((o_orderkey * 11) % 1944 AS DOUBLE) AS v", "CAST(o_orderkey % 5 AS BIGINT) AS inliers"]),
    "obs": ("customer", ["c_custkey AS image_id", "CAST((c_custkey * 5) % 13 AS BIGINT) AS kp_id", "c_custkey AS pt_id", "CAST((c_custkey * 19) % 2592 AS DOUBLE) AS pu", "CAST((c_custkey * 29) % 1944 AS DOUBLE) AS pv", "CAST((c_custkey * 19) % 256 AS BIGINT) AS gray", "c_custkey % 5 = 0 AS offscreen"]),
    "image": ("orders", ["o_orderkey AS image_id", "CAST(floor(o_custkey / 10) AS BIGINT) AS node", "(1704067200 + (o_orderkey * 163) % 2500000) * 1000000 AS ts_us"]),
    "ray": ("customer", ["c_custkey AS ray_id", "(c_custkey * 17) % 100 + 0.5e0 AS e0", "(c_custkey * 23) % 75 + 0.5e0 AS n0", "103 + (c_custkey % 50) * 0.25e0 AS z0", "(c_custkey % 21 - 10) / 10e0 AS x", "(c_custkey % 17 - 8) / 10e0 AS y", "(c_custkey % 9 - 7) / 20e0 AS z"]),
    "scene": ("orders", ["o_orderkey AS id", "o_orderdate AS acquired", "(o_orderkey % 100) / 100e0 AS cloud_cover"]),
    "pole": ("part", ["p_partkey AS pole_id", "p_name AS name", "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'Wooden pole' WHEN p_partkey % 5 = 2 THEN 'Steel Standard' WHEN p_partkey % 5 = 3 THEN '' ELSE p_type END AS pole_type", "CASE WHEN p_partkey % 3 = 0 THEN 'Joint use (city)' WHEN p_partkey % 3 = 1 THEN 'CITY of S' ELSE p_brand END AS owner", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 43 + (p_partkey % 97) * 1e-3 END AS lat", "-76 - (p_partkey % 89) * 1e-3 AS lon", "CAST(floor(p_partkey / 8) AS BIGINT) AS asset"]),
    "file": ("pages", ["page_id AS file_id", "concat(CASE WHEN page_id % 9 = 0 THEN '.hidden/' WHEN page_id % 4 = 0 THEN 'a/b/' WHEN page_id % 4 = 1 THEN 'a/' WHEN page_id % 4 = 2 THEN 'c/' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN 'Thermal_' WHEN page_id % 13 = 0 THEN 'xLWIR' ELSE 'img' END, page_id % 500, CASE WHEN page_id % 3 = 0 THEN '.JPG' WHEN page_id % 3 = 1 THEN '.png' ELSE '.txt' END) AS path"]),
    "comment": ("events", ["event_id", "CASE WHEN event_id % 10 = 0 THEN 'no orientation' ELSE concat('ROLL ', event_id % 21 - 10, ' pitch ', -(event_id % 90), '.25 Yaw ', (event_id * 37) % 360) END AS comment"]),
    "vec": ("embeddings", ["vec_id", "embedding", "CAST(floor(vec_id / 25) AS BIGINT) AS image_id"]),
    "reading": ("events", ["event_id", "CAST(user_id AS BIGINT) AS node", "event_id % 256 AS lo", "(event_id * 7) % 256 AS hi", "(event_id * 13) % 256 AS status", "CASE WHEN event_id % 4 = 0 THEN ' Yes' WHEN event_id % 4 = 1 THEN 'n' WHEN event_id % 4 = 2 THEN '1' ELSE NULL END AS answer", "event_id % 180 AS deg", "event_id % 60 AS mins", "(event_id * 7) % 60 AS secs", "CASE WHEN event_id % 4 < 2 THEN 'N' ELSE 'w' END AS hemi", f"{MICROS} AS ts_us"]),
    "splat": ("lineitem", ["l_orderkey * 8 + l_linenumber AS splat_id", "l_extendedprice AS price", "(l_partkey % 1000) / 1000e0 AS opacity"]),
    "reproj": ("customer", ["c_custkey AS obs_id", "CAST(floor(c_custkey / 15) AS BIGINT) AS image_id", "(c_custkey % 11 - 5) / 4e0 AS dx", "(c_custkey % 7 - 3) / 4e0 AS dy", "(c_custkey % 10 - 1) / 2e0 AS za", "(c_custkey % 12 - 1) / 2e0 AS zb"]),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return read(spark, sf_dir, table).selectExpr(*columns)


def sql(*names: str) -> str:
    """The views as the opening of a WITH clause."""
    return "WITH " + ",\n".join(f"v_{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names).replace(MICROS, MICROS_SQL)
