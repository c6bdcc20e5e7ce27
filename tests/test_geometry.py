import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from terraloom.functions import camera, geodesy
from terraloom.operators import points
from terraloom.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    oracle.same(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE[name])


def test_grid_has_every_camera(spark):
    found = QUERIES["flat_grid"](spark, SF)
    cameras = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert found.agg(F.count_distinct("cam_id")).first()[0] > 0.9 * cameras


def test_a_table_of_one_file_is_dealt_out_to_all_cores(spark):
    found = QUERIES["flat_grid"](spark, SF)
    assert found.rdd.getNumPartitions() >= 8
    assert points.pixel_grid(spark.range(40).coalesce(1), 300, 300, 100).rdd.getNumPartitions() >= 8


def test_grid_in_arrays_is_the_grid_in_columns(spark):
    rows = [(i, 43.0 + i / 7, -76.0 - i / 3, 3.0 + i, 37.0 * i, -5.0 - 8 * i, i - 5.0) for i in range(11)] + [(50, 43.0, -76.0, 4.0, 10.0, 30.0, 0.0), (51, 43.0, -76.0, None, 10.0, -30.0, 0.0), (None, 0.0, 0.0, 2.0, 10.0, -90.0, 0.0), (52, 43.0, -76.0, 0.0, 10.0, -60.0, 0.0)]
    cameras = camera.prepare_cameras(spark.createDataFrame(rows, "id long, cam_lat double, cam_lon double, height double, heading double, pitch double, roll double"))
    k = (1200.0, 1210.0, 960.0, 540.0)
    told = lambda df: sorted(((r.id or -1, r.u, r.v), (r.lat, r.lon)) for r in df.collect())
    want = told(camera.pixels_to_ground(points.pixel_grid(cameras, 1920, 1080, 60), *k, on_miss="drop"))
    for rows_at_once in (camera.GRID_ROWS, 100):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(camera, "GRID_ROWS", rows_at_once)
            found = told(camera.grid_to_ground(cameras, "id", 1920, 1080, 60, *k))
        assert [x for x, _ in found] == [x for x, _ in want] and len(found) > 3000
        assert max(abs(a - b) for (_, x), (_, y) in zip(found, want) for a, b in zip(x, y)) < 1e-12


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {n for n in QUERIES if n.startswith(("op", "pipeline"))}))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_known_positions_of_a_level_camera(spark):
    """A calibrated camera one metre above the ground that looks east."""
    known = {(0, 1000): (43.15840385557345, -76.13778811706196), (100, 1000): (43.15839044201582, -76.13778811717998), (800, 1500): (43.158240814174306, -76.13826381662399), (2500, 1900): (43.15822189609613, -76.13829022517854)}
    one = spark.createDataFrame([(43.1582333333333, -76.1383276666667, 1.0, 90.0, 0.0, 0.0)], "cam_lat double, cam_lon double, height double, heading double, pitch double, roll double")
    grid = points.pixel_grid(camera.prepare_cameras(one), 2592, 1944, 100)
    found = camera.pixels_to_ground(grid, 2944.738891849689, 2945.020052325181, 1271.277276119622, 932.8880659656849, on_miss="drop").collect()
    assert len(found) == 260
    told = {(r.u, r.v): (r.lat, r.lon) for r in found}
    for at, want in known.items():
        assert told[at] == pytest.approx(want, abs=1e-12)
    assert sum(r.lat for r in found) / 260 == pytest.approx(43.158234027425, abs=1e-11)
    assert sum(r.lon for r in found) / 260 == pytest.approx(-76.138196418783, abs=1e-11)


def _hit(spark, u, v, pitch, on_miss="null"):
    df = spark.createDataFrame([(u, v, 0.0, 0.0, 10.0, 0.0, pitch, 0.0)], "u double, v double, cam_lat double, cam_lon double, height double, heading double, pitch double, roll double")
    return camera.pixels_to_ground(camera.prepare_cameras(df), 1200.0, 1200.0, 960.0, 540.0, on_miss=on_miss).collect()


def test_nadir_centre_is_below_the_camera(spark):
    (row,) = _hit(spark, 960.0, 540.0, -90.0)
    assert abs(row.lat) < 1e-6 and abs(row.lon) < 1e-6


def test_misses(spark):
    assert _hit(spark, 960.0, 100.0, 0.0)[0].lat is None
    assert _hit(spark, 960.0, 100.0, 0.0, "drop") == []
    with pytest.raises(Exception, match="doesn't meet the ground"):
        _hit(spark, 960.0, 100.0, 0.0, "error")


def test_plane_round_trip(spark):
    df = spark.createDataFrame([(1500.0, -700.0, 43.05, -76.12)], "e double, n double, lat0 double, lon0 double")
    df = geodesy.latlon_to_enu(geodesy.enu_to_latlon(df, "e", "n", "lat0", "lon0"), "lat", "lon", "lat0", "lon0")
    row = df.first()
    assert abs(row.east - 1500) < 1e-5 and abs(row.north + 700) < 1e-5


def test_selection_by_grid_spreads_points(spark):
    rows = [(1, i, 10.0 + i % 5, 10.0) for i in range(50)] + [(1, 50, 900.0, 10.0), (1, 51, 10.0, 700.0), (1, 52, 900.0, 700.0)]
    df = spark.createDataFrame(rows, "img long, seq long, u double, v double")
    found = points.select_by_grid(df, ["img"], ["seq"], 1000, 800, 6, 4, 4).collect()
    assert len(found) == 4 and any(r.u > 100 for r in found)


def test_ring_closure(spark):
    df = spark.createDataFrame([([1, 2, 1],)], "ring array<int>")
    row = df.select(points.close_ring(F.col("ring")).alias("a"), points.close_ring(F.col("ring"), False).alias("b")).first()
    assert row.a == [1, 2, 1, 1] and row.b == [1, 2, 1]
