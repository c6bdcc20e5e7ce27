import time

import numpy as np
import pytest

from terraloom.functions import camera
from terraloom.operators import fitting, matching

K = (2944.738891849689, 2945.020052325181, 1271.277276119622, 932.8880659656849)


def test_spline_passes_through_its_points_and_keeps_planes(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 2000, (8, 2))
    rows = [(1, float(u), float(v), 43 + 1e-6 * u - 2e-6 * v, -76 + 3e-6 * u + 1e-6 * v) for u, v in at.tolist()]
    bent = [(2, *r[1:3], r[3] + 1e-4 * float(rng.random()), r[4]) for r in rows]
    few = [(3, *r[1:]) for r in rows[:5]]
    df = spark.createDataFrame(rows + bent + few, "g long, pixel_u double, pixel_v double, lat double, lon double")
    weights = fitting.fit_spline(df, "g")
    pixels = spark.createDataFrame([(100 * r[0] + i, r[0], r[1], r[2]) for k in (rows, bent, few) for i, r in enumerate(k)] + [(999, 1, 5000.0, -300.0)], "id long, g long, u double, v double")
    found = {r.id: (r.lat, r.lon) for r in fitting.apply_spline(pixels, weights, "g", "id").collect()}
    for k in (rows, bent):
        for i, r in enumerate(k):
            assert found[100 * r[0] + i] == pytest.approx(r[3:], abs=1e-9)
    assert found[999] == pytest.approx((43 + 5e-3 + 6e-4, -76 + 1.5e-2 - 3e-4), abs=1e-7)
    assert not any(300 <= i < 400 for i in found)


def test_similarity_finds_a_planted_one(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    src = rng.normal(size=(20, 3))
    dst = 2.5 * src @ q.T + [10, -20, 5]
    rows = [(1, *map(float, a), *map(float, b)) for a, b in zip(src, dst)] + [(2, *[0.0] * 6)] * 2
    (r,) = fitting.fit_similarity(spark.createDataFrame(rows, "g long, x double, y double, z double, tx double, ty double, tz double"), "g").collect()
    assert r.scale == pytest.approx(2.5) and np.allclose(np.array(r.rotation).reshape(3, 3), q) and np.allclose(r.shift, [10, -20, 5])


def test_pose_comes_back_from_its_own_points(spark):
    true = (43.15, -76.13, 6.0, 30.0, -25.0, 2.0)
    pix = [(float(u), float(v)) for u in (200, 900, 1600, 2400) for v in (900, 1300, 1800)]
    df = spark.createDataFrame([(1, *true, u, v) for u, v in pix], "g long, cam_lat double, cam_lon double, height double, heading double, pitch double, roll double, u double, v double")
    hits = camera.pixels_to_ground(camera.prepare_cameras(df), *K).select("u", "v", "lat", "lon").collect()
    start = (43.15002, -76.13002, 6.3, 32.0, -24.0, 1.0)
    rows = [(1, *start, r.u, r.v, r.lat, r.lon) for r in hits] + [(2, *start, *hits[0])]
    found = {r.g: r for r in fitting.refine_poses(spark.createDataFrame(rows, "g long, cam_lat double, cam_lon double, height double, heading double, pitch double, roll double, pixel_u double, pixel_v double, lat double, lon double"), "g", K).collect()}
    assert found[1].rms_deg < 2e-7
    assert (found[2].lat, found[2].heading, found[2].rms_deg) == (43.15002, 32.0, None)


def test_many_poses_are_fitted_together_as_each_alone(spark):
    """1,500 images of 2 to 9 points; fits are exact to far below a millimetre."""
    rng = np.random.default_rng(5)
    rows, true = [], {}
    for g in range(1500):
        n = 2 + g % 8
        pose = np.array([[-76.0, 43.0 + g * 1e-4, 6.0, 30.0 + g % 90, -40.0, 2.0]])
        u, v = rng.uniform(100, 2500, (1, n)), rng.uniform(100, 1800, (1, n))
        lat, lon = fitting._ground(pose, u, v, K)
        near = pose[0] + [1e-5, -1e-5, 0.2, 1.0, 0.5, -0.5]
        true[g] = near
        rows += [(g, float(near[1]), float(near[0]), *map(float, near[2:]), *map(float, r)) for r in zip(u[0], v[0], lat[0], lon[0])]
        if g % 5 == 0:
            rows.append((*rows[-1][:9], None, -76.0))
    names = "g long, cam_lat double, cam_lon double, height double, heading double, pitch double, roll double, pixel_u double, pixel_v double, lat double, lon double"
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], names)
    found = {r.g: r for r in fitting.refine_poses(df, "g", K).collect()}
    assert len(found) == 1500
    for g, r in found.items():
        if g % 8 == 0:
            assert r.rms_deg is None and (r.lon, r.lat, r.height, r.heading, r.pitch, r.roll) == pytest.approx(tuple(true[g]))
        else:
            assert r.rms_deg is not None
    assert np.median([r.rms_deg for r in found.values() if r.rms_deg is not None]) < 1e-9
    with pytest.MonkeyPatch.context() as patch:  # in small parts, cut anywhere
        patch.setattr(fitting, "FIT_POINTS", 20)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        few = {r.g: r for r in fitting.refine_poses(df.where("g < 100"), "g", K).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(few) == 100
    for g, r in few.items():
        assert (r.rms_deg is None) == (g % 8 == 0)
        assert (r.height, r.heading) == pytest.approx((found[g].height, found[g].heading), abs=1e-3) or r.rms_deg < 1e-7


def test_nearest_in_time_matches_a_search(spark):
    rng = np.random.default_rng(3)
    left = [(i, int(rng.integers(4)), int(rng.integers(5000))) for i in range(300)]
    right = [(i, int(rng.integers(3)), int(rng.integers(5000)) // 7 * 7) for i in range(200)]
    df = matching.nearest_in_time(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "o long, k long, t long"), "k", "t", "o", 100)
    found = {r.id: r.near and r.near.o for r in df.collect()}
    for i, k, t in left:
        assert found[i] == min(((abs(t - u), o) for o, g, u in right if g == k), default=(None, None))[1]


def _spread(spark):
    """Rows of ids, groups and codes: one group of all codes of 6 bits, one of few rows, one of equal codes."""
    rng = np.random.default_rng(6)
    rows = [(0, int(x)) for x in rng.integers(64, size=900)] + [(1, int(x)) for x in rng.integers(64, size=9)] + [(2, 5)] * 40 + [(3, 7), (4, None), (4, 1), (4, 62)]
    return [(100 + i, g, x) for i, (g, x) in enumerate(rows)]


def test_two_nearest_codes_are_those_of_all_pairs(spark):
    df = spark.createDataFrame(_spread(spark), "id long, g long, x long").where("x IS NOT NULL")
    queries = df.where("id % 3 = 0 OR g > 2").selectExpr("g", "id AS q_id", "x AS q_code")
    base = df.selectExpr("g", "id AS b_id", "x AS b_code")
    want = matching.two_nearest(queries, base, "g", matching.hamming_distance("q_code", "b_code")).selectExpr("q_id", "first", "CAST(d1 AS long) d1", "second", "CAST(d2 AS long) d2")
    for bits in (6, 13):
        found = matching.two_nearest_codes(queries, base, "g", bits).select(want.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(Exception, match="more than 5 bits"):
        matching.two_nearest_codes(queries, base, "g", 5).collect()


def test_no_row_for_each_pair(spark):
    """A group of 20,000 rows has 400,000,000 pairs; what is joined has a row for each ray and array, or query."""
    rays = spark.range(20000).selectExpr("id AS ray_id", "1L AS g", "sin(id) AS dx", "cos(id) AS dy", "0D AS dz")
    pts = spark.range(3000).selectExpr("1L AS g", "id AS pt_id", "id % 50 AS x", "id % 31 AS y", "id % 7 AS z").selectExpr("g", "pt_id", "CAST(x AS double) x", "CAST(y AS double) y", "CAST(z AS double) z")
    found = {r.ray_id: r for r in matching.nearest_to_ray(rays.where("ray_id % 1000 = 0"), pts, "g").collect()}
    p = np.array([(r.x, r.y, r.z) for r in pts.orderBy("pt_id").collect()])
    for i in range(0, 20000, 1000):
        d = np.array([np.sin(i), np.cos(i), 0.0])
        t = p @ d
        d2 = np.where(t >= 0, ((p - t[:, None] * d) ** 2).sum(axis=1), np.inf)
        assert (i in found) == (d2.min() < 400)
        if i in found:
            assert found[i].d2 == pytest.approx(d2.min(), abs=1e-9) and found[i].t == pytest.approx(t[found[i].pt_id]) and d2[found[i].pt_id] == pytest.approx(d2.min(), abs=1e-9)
    codes = spark.range(20000).selectExpr("1L AS g", "id", "(id * 2654435761) % 65536 AS x")
    start = time.perf_counter()
    assert matching.two_nearest_codes(codes.selectExpr("g", "id AS q_id", "x AS q_code"), codes.selectExpr("g", "id AS b_id", "x AS b_code"), "g", 16).count() == 20000
    assert time.perf_counter() - start < 30
