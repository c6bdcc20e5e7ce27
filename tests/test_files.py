import json
import struct

import pytest
from pyspark.sql import functions as F

from terraloom.operators import inspection
from terraloom.sources import sinks, tables
from terraloom.streaming import imu


def test_gcps_round_trip(spark, tmp_path):
    rows = [("GCP1", 10.5, 20.25, 43.1, -76.1, None), ("GCP2", 1.0, 2.0, 43.2, -76.2, 101.5)]
    df = spark.createDataFrame(rows, "label string, pixel_u double, pixel_v double, lat double, lon double, elev_m double")
    sinks.write_gcps(df, str(tmp_path / "g"))
    assert sorted(map(tuple, tables.read_gcps(spark, str(tmp_path / "g")).collect())) == rows
    (tmp_path / "short.csv").write_text("label,pixel_u,pixel_v,lat,lon\n A ,1,2,3,4\n")
    assert tables.read_gcps(spark, str(tmp_path / "short.csv")).collect()[0][:] == ("A", 1.0, 2.0, 3.0, 4.0, None)
    (tmp_path / "bad.csv").write_text("label,pixel_u,pixel_v,lat,lon,elev_m\nA,x,2,3,4,\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_gcps(spark, str(tmp_path / "bad.csv")).collect()


def test_grid_round_trip_and_header_only(spark, tmp_path):
    df = spark.createDataFrame([(0, 1000, 43.15, -76.13)], "pixel_x int, pixel_y int, lat double, lon double")
    sinks.write_grid(df, str(tmp_path / "g"))
    assert tables.read_grid(spark, str(tmp_path / "g")).collect() == df.collect()
    (tmp_path / "empty.csv").write_text("pixel_x,pixel_y,lat,lon\r\n")
    assert tables.read_grid(spark, str(tmp_path / "empty.csv")).collect() == []


def test_intrinsics_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"K": [[9.0, 0, 3.5], [0, 8.0, 2.5], [0, 0, 1]], "D": [[-0.4, 0.2, 0, 0, -0.1]], "rms": 0.25}, indent=2))
    one = tables.read_intrinsics(spark, str(tmp_path / "c.json"))
    r = one.first()
    assert (r.fx, r.fy, r.cx, r.cy, r.distortion, r.width, r.camera_height_m) == (9.0, 8.0, 3.5, 2.5, [-0.4, 0.2, 0.0, 0.0, -0.1], None, None)
    sinks.write_intrinsics(one, str(tmp_path / "out"))
    assert tables.read_intrinsics(spark, str(tmp_path / "out")).first() == r


def test_poses_skip_bad_rows_and_captures(spark, tmp_path):
    (tmp_path / "p.csv").write_text("frame_id,lat_deg,lon_deg,alt_ellipsoid_m,yaw_deg\na,43,-76,100,5\nb,x,-76,100,5\nc,43,,100,5\n")
    (r,) = tables.read_poses(spark, str(tmp_path / "p.csv")).collect()
    assert (r.frame_id, r.yaw_deg, r.sigma_h_m) == ("a", 5.0, None)
    caps = {"captures": [{"id": "k1", "geolocation": {"coordinates": [43.0, -76.0, 70.5], "sigmas": [0.1, 0.1, 0.04]}, "orientation": {"angles_deg": [1, 2, 3]}}, {}]}
    (tmp_path / "cams.json").write_text(json.dumps(caps, indent=1))
    one, bare = tables.read_captures(spark, str(tmp_path / "cams.json")).collect()
    assert one[:] == ("k1", 43.0, -76.0, 70.5, 0.1, 0.04, 1.0, 2.0, 3.0, None, None, None)
    assert bare[:] == ("", *[None] * 11)
    sinks.write_poses(tables.read_captures(spark, str(tmp_path / "cams.json")).where("frame_id <> ''"), str(tmp_path / "poses"))
    assert tables.read_poses(spark, str(tmp_path / "poses")).first()[:] == one[:]


@pytest.mark.parametrize("crs", ["EPSG:6347", {"definition": "EPSG:6347"}])
def test_scene_frame(spark, tmp_path, crs):
    base = tmp_path / "point_clouds" / "legacy"
    base.mkdir(parents=True)
    (base / "scene_reference_frame.json").write_text(json.dumps({"base_to_canonical": {"shift": [1, 2, 3], "scale": [1, 1, 1], "swap_xy": False}, "crs": crs}))
    assert tables.read_scene_frame(spark, str(tmp_path)).first()[:] == ([1.0, 2.0, 3.0], "EPSG:6347")
    with pytest.raises(FileNotFoundError):
        tables.read_scene_frame(spark, str(tmp_path / "none"))


def test_cloud_in_parts_and_too_short(spark, tmp_path):
    base = tmp_path / "point_clouds" / "legacy"
    base.mkdir(parents=True)
    points = [(i, -i, i / 2, 0.5, 1.5, -1.0) for i in range(250)]
    (base / "pointcloud.gltf").write_text(json.dumps({"accessors": [{"count": 250}], "bufferViews": [{"byteStride": 24}]}))
    (base / "pointcloud.bin").write_bytes(b"".join(struct.pack("<6f", *p) for p in points))
    found = sorted(map(tuple, tables.read_cloud(spark, str(tmp_path), 100).collect()))
    assert found == [(float(i), float(-i), i / 2, 127, 255, 0) for i in range(250)]
    sinks.write_ply(tables.read_cloud(spark, str(tmp_path), 100), str(tmp_path / "ply"))
    lines = next((tmp_path / "ply").glob("part-*")).read_text().splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 250"] and len(lines) == 260
    assert lines[10] == "0.000000 0.000000 0.000000 127 255 0"
    (base / "pointcloud.bin").write_bytes(b"\0" * 5000)
    with pytest.raises(ValueError, match="5000 bytes"):
        tables.read_cloud(spark, str(tmp_path))


def test_listing_of_files(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.txt", "sub/d.jpeg", ".hid/e.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(tables.list_files(spark, f"file://{tmp_path}")) == ["a.JPG", "b.png"]
    assert names(tables.list_files(spark, f"file://{tmp_path}", deep=True)) == ["a.JPG", "b.png", "d.jpeg"]
    assert names(tables.list_files(spark, f"file://{tmp_path}", deep=True, limit=1)) == ["a.JPG"]


def test_features_and_polygons(spark, tmp_path):
    df = spark.createDataFrame([(1, -76.5, 43.25), (2, None, 43.0)], "id long, lon double, lat double")
    sinks.write_collection(sinks.features(df), str(tmp_path / "f"))
    told = json.loads(next((tmp_path / "f").glob("part-*")).read_text())
    told["features"].sort(key=lambda f: f["properties"]["id"])
    assert told["features"][0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-76.5, 43.25]}, "properties": {"id": 1}}
    assert told["features"][1]["geometry"] is None
    ring = spark.createDataFrame([(1, i, float(i), float(i * i)) for i in range(4)] + [(2, 0, 0.0, 0.0)], "g long, i long, lon double, lat double")
    (line,) = sinks.polygon(ring, "g", "i", "water_boundary").collect()
    (coords,) = json.loads(line.value)["geometry"]["coordinates"]
    assert len(coords) == 5 and coords[0] == coords[-1]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(7, 150.04, 90.0, 0.5, 12.0, 0.25, True), (8, 10.0, 300.0, 0.01, 1.0, 9.0, False)], "image_id long, sharpness double, brightness double, coverage double, tilt_deg double, reproj_error double, corners_found boolean")
    sinks.write_report(sinks.one_file(inspection.verdicts(df)), str(tmp_path / "r"))
    lines = next((tmp_path / "r").glob("part-*")).read_text().splitlines()
    assert lines == ["image_id,sharpness,brightness,coverage,tilt_deg,reproj_error,selected,reject_reasons", "7,150.0,90.0,0.5000,12.00,0.2500,yes,", "8,10.0,300.0,0.0100,1.00,9.0000,no,sharpness; exposure; corners; reproj"]


LOG = "timestamp,tilt_deg,roll_deg,yaw_deg,temp_c,calib_sys,calib_gyro,calib_accel,calib_mag\n"


def test_stream_of_a_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text(LOG + "2024-05-01T10:00:00,1,2,350.5,20,3,3,0,1\n2024-05-01T10:00:30,1,2,10.5,20,3,3,3,3\n")
    alerts = imu.alerts(imu.read_log(spark, str(source))).drop("ts")
    for extra in (None, "2024-05-01T10:01:00,1,2,20,20,0,0,0,0\n"):
        if extra:
            (source / "2.csv").write_text(LOG + extra)
        imu.append_log(alerts, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    found = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(r.timestamp for r in found.collect()) == ["2024-05-01T10:00:00", "2024-05-01T10:01:00"]
    assert tables.read_imu(spark, str(source / "1.csv")).orderBy("place").first().yaw_deg == 350.5


def test_corrected_headings(spark):
    df = spark.createDataFrame([("t", 1.23456, 2.0, 5.0, 20.04, 3, 3, 3, 1)], "timestamp string, pitch double, roll double, heading double, temp double, calib_sys int, calib_gyro int, calib_accel int, calib_mag int")
    assert imu.corrected(df, -11.5).first()[:5] == ("t", 1.235, 2.0, 353.5, 20.0)


def _stream(spark, tmp_path, df, name):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def _run(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


READINGS = "node long, ts timestamp, yaw_deg double, calib_gyro int, calib_accel int, calib_mag int"


def test_windows_and_guided_calibration(spark, tmp_path):
    rows = [(1, f"2024-05-01 10:00:0{i}", float(i), g, a, m) for i, (g, a, m) in enumerate([(0, 0, 0), (3, 3, 0), (0, 0, 2), (0, 0, 3)])] + [(1, "2024-05-01 11:00:00", 0.0, 0, 0, 0)]
    df = spark.createDataFrame(rows, READINGS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    log = _stream(spark, tmp_path, df, "log")
    first = [r for r in _run(spark, imu.heading_windows(log, "node"), tmp_path, "windows") if r.start.hour == 10]
    assert [(r.node, r.n, r.mean_deg) for r in first] == [(1, 4, 1.5)]
    steps = _run(spark, imu.guided_calibration(log), tmp_path, "steps")
    assert [(r.stage, r.done) for r in steps] == [("gyro", False), ("gyro", True), ("accel", False), ("accel", True), ("mag", False), ("mag", True)]


def test_images_meet_readings_of_their_time(spark, tmp_path):
    time = F.to_timestamp
    log = spark.createDataFrame([(1, "2024-05-01 10:00:00", 7.0), (1, "2024-05-01 10:00:08", 8.0), (1, "2024-05-01 12:00:00", 9.0)], "node long, ts string, yaw_deg double").withColumn("ts", time("ts"))
    images = spark.createDataFrame([(5, 1, "2024-05-01 10:00:03"), (6, 2, "2024-05-01 10:00:03"), (7, 1, "2024-05-01 12:00:00")], "image_id long, node long, taken string").withColumn("taken", time("taken"))
    found = _run(spark, imu.nearest_reading(_stream(spark, tmp_path, images, "images"), _stream(spark, tmp_path, log, "log2"), "node"), tmp_path, "near")
    assert min((r.gap_us, r.yaw_deg) for r in found if r.image_id == 5) == (3_000_000, 7.0)
