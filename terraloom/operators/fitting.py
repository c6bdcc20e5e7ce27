"""Models fitted to a group's few control points: splines, similarities and poses.

Each group's points are one image's or scan's, tens of them, so a group is one small
array; groups are dealt out by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Control points that a spline, a similarity and a pose need; the penalty
#: of a point that misses the ground, and the scale and evaluations of the robust fit.
LEAST_SPLINE, LEAST_SIMILARITY, LEAST_POSE = 6, 3, 3
MISS, LOSS_SCALE, EVALUATIONS = 100.0, 0.1, 500
#: A fit ends when a step gains less than this share of its loss.
SETTLED = 1e-8
#: Control points of the images that are fitted at once, about.
FIT_POINTS = 20_000
WEIGHTS = "px double, py double, w_lat double, w_lon double"
SIMILARITY = "scale double, rotation array<double>, shift array<double>, n long"
POSE = "lat double, lon double, height double, heading double, pitch double, roll double, rms_deg double"


def _kernel(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0)


def fit_spline(gcps: DataFrame, by: str) -> DataFrame:
    """Thin-plate splines from pixel_u, pixel_v to lat and lon: ``by`` and WEIGHTS of each
    control point, and three rows more of each group with a null px: the weights of 1, u
    and v (py is 0, 1, 2).  Groups of fewer than LEAST_SPLINE different points give none."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["pixel_u", "pixel_v"])
        at = pdf[["pixel_u", "pixel_v"]].to_numpy(float)
        n = len(at)
        names = [by, "px", "py", "w_lat", "w_lon"]
        if n < LEAST_SPLINE:
            return pd.DataFrame({k: [] for k in names})
        # the plane is solved about the points' middle and in their spread, as the kernel is far larger
        middle, spread = at.mean(axis=0), max(float(at.std()), 1.0)
        flat = np.column_stack([np.ones(n), (at - middle) / spread])
        bend = _kernel(((at[:, None] - at[None]) ** 2).sum(-1)) / spread**2
        told = np.vstack([pdf[["lat", "lon"]].to_numpy(float), np.zeros((3, 2))])
        level = told[:n].mean(axis=0)
        told[:n] -= level
        w = np.linalg.lstsq(np.block([[bend, flat], [flat.T, np.zeros((3, 3))]]), told, rcond=None)[0]
        w[:n] /= spread**2
        w[n + 1 :] /= spread
        w[n] += level - middle @ w[n + 1 :]
        return pd.DataFrame({by: key[0], "px": [*at[:, 0], *[np.nan] * 3], "py": [*at[:, 1], 0.0, 1.0, 2.0], "w_lat": w[:, 0], "w_lon": w[:, 1]})

    return gcps.select(by, "pixel_u", "pixel_v", "lat", "lon").groupBy(by).applyInPandas(fit, f"{by} long, {WEIGHTS}").withColumn("px", F.nanvl("px", F.lit(None).cast("double")))


def apply_spline(pixels: DataFrame, weights: DataFrame, by: str, pixel_id: str) -> DataFrame:
    """``pixel_id``, lat and lon of pixels (u, v) by their group's spline; it goes on beyond
    the control points."""
    r2 = (c("u") - c("px")) * (c("u") - c("px")) + (c("v") - c("py")) * (c("v") - c("py"))
    term = F.when(c("px").isNull(), F.when(c("py") == 0, 1.0).when(c("py") == 1, c("u")).otherwise(c("v"))).otherwise(F.when(r2 > 0, 0.5 * r2 * F.log(r2)).otherwise(0.0))
    both = pixels.join(weights, by).withColumn("_t", term)
    return both.groupBy(pixel_id).agg(F.sum(c("_t") * c("w_lat")).alias("lat"), F.sum(c("_t") * c("w_lon")).alias("lon"))


def fit_similarity(pairs: DataFrame, by: str) -> DataFrame:
    """SIMILARITY that takes (x, y, z) closest to (tx, ty, tz), for each group of at least
    LEAST_SIMILARITY points.  Moments are summed by Spark; only 3 x 3 matrices are solved
    in Python, so a group may be of any size."""
    src, dst = ("x", "y", "z"), ("tx", "ty", "tz")
    centre = pairs.groupBy(by).agg(*(F.avg(k).alias(f"m_{k}") for k in (*src, *dst)))
    off = lambda k: c(k) - c(f"m_{k}")
    moments = pairs.join(centre, by).groupBy(by).agg(F.count("*").alias("n"), *(F.first(f"m_{k}").alias(f"m_{k}") for k in (*src, *dst)), F.avg(sum((off(k) * off(k) for k in src), F.lit(0.0))).alias("spread"), *(F.avg(off(d) * off(s)).alias(f"s_{d}{s}") for d in dst for s in src)).where(c("n") >= LEAST_SIMILARITY)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                left, size, right = np.linalg.svd(np.array([[r[f"s_{d}{s}"] for s in src] for d in dst]))
                mirror = np.array([1.0, 1.0, np.sign(np.linalg.det(left @ right))])
                turn = left @ np.diag(mirror) @ right
                scale = float((size * mirror).sum() / r["spread"]) if r["spread"] > 0 else 1.0
                shift = np.array([r[f"m_{k}"] for k in dst]) - scale * turn @ np.array([r[f"m_{k}"] for k in src])
                out.append((r[by], scale, turn.ravel().tolist(), shift.tolist(), r["n"]))
            yield pd.DataFrame(out, columns=[by, "scale", "rotation", "shift", "n"])

    return moments.mapInPandas(solve, f"{by} long, {SIMILARITY}")


def _ground(pose: np.ndarray, u: np.ndarray, v: np.ndarray, k: tuple) -> tuple[np.ndarray, np.ndarray]:
    """lat and lon of pixels (one row for each pose) on flat ground; NaN for a miss.  Metres
    become degrees by the ellipsoid's radii at the camera, good to millimetres near it."""
    lon, lat, height, heading, pitch, roll = (x[:, None] for x in pose.T)
    fx, fy, cx, cy = k
    (sh, ch), (sp, cp), (sr, cr) = ((np.sin(x), np.cos(x)) for x in map(np.radians, (heading, pitch, roll)))
    x, y = (u - cx) / fx, (v - cy) / fy
    # forward x level right is the level down axis
    east = x * (cr * ch + sr * sh * sp) + y * (cr * sh * sp - sr * ch) + sh * cp
    north = x * (sr * ch * sp - cr * sh) + y * (cr * ch * sp + sr * sh) + ch * cp
    up = sp - (x * sr + y * cr) * cp
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(up < -1e-9, -height / up, np.nan)
    a, e2 = 6378137.0, 0.0066943799901413165
    w = 1 - e2 * np.sin(np.radians(lat)) ** 2
    return lat + np.degrees(far * north * w**1.5 / (a * (1 - e2))), lon + np.degrees(far * east * np.sqrt(w) / (a * np.cos(np.radians(lat))))


def _damped(normal: np.ndarray, slope: np.ndarray, damp: np.ndarray) -> np.ndarray:
    """The least step of each damped system; directions that say nothing don't move."""
    at = np.arange(normal.shape[1])
    own = normal.copy()
    own[:, at, at] += damp[:, None] * (normal[:, at, at] + 1e-30)
    left, size, right = np.linalg.svd(own)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(size > np.finfo(float).eps * len(at) * size[:, :1], 1 / size, 0.0)
    along = share * (left.transpose(0, 2, 1) @ slope[:, :, None])[:, :, 0]
    return -(right.transpose(0, 2, 1) @ along[:, :, None])[:, :, 0]


def _fit_poses(start: np.ndarray, points: np.ndarray, k: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Poses (lon, lat, height, heading, pitch, roll) and rms of images of equally many
    points: start is (images, 6), points (4, images, points).  Each image takes its own
    steps; only their arithmetic is done for all images at once."""
    u, v, lat, lon = points
    lo = np.column_stack([start[:, :2] - 0.002, np.broadcast_to([0.1, -360, -90, -180], (len(start), 4))])
    hi = np.column_stack([start[:, :2] + 0.002, np.broadcast_to([200, 360, 0, 180], (len(start), 4))])
    unit = np.array([1e-6, 1e-6, 1e-3, 1e-4, 1e-4, 1e-4])

    def errors(x: np.ndarray, who: np.ndarray) -> np.ndarray:
        a, b = _ground(x, u[who], v[who], k)
        return np.concatenate([np.where(np.isnan(a), MISS, a - lat[who]), np.where(np.isnan(b), MISS, b - lon[who])], axis=1)

    def loss(e: np.ndarray) -> np.ndarray:
        q = (e / LOSS_SCALE) ** 2  # sqrt(1 + q) - 1, without the loss of digits that small errors would bring
        return LOSS_SCALE**2 * (q / (1 + np.sqrt(1 + q))).sum(axis=1)

    x, n = np.clip(start, lo, hi), len(start)
    damp, used, cost = np.full(n, 1e-3), np.zeros(n, int), np.zeros(n)
    normal, slope, fresh = np.zeros((n, 6, 6)), np.zeros((n, 6)), np.ones(n, bool)
    who = np.arange(n)
    while len(who):
        if len(new := who[fresh[who]]):  # these have moved: what their errors do about the new pose
            e = errors(x[new], new)
            j = np.stack([errors(x[new] + unit * row, new) - e for row in np.eye(6)], axis=2)  # in units of each parameter
            weighed = j / np.sqrt(1 + (e / LOSS_SCALE) ** 2)[:, :, None]
            normal[new], slope[new], cost[new] = weighed.transpose(0, 2, 1) @ j, (weighed * e[:, :, None]).sum(axis=1), loss(e)
            used[new] += 7
            fresh[new] = False
            who = who[used[who] < EVALUATIONS]
        made = np.clip(x[who] + unit * _damped(normal[who], slope[who], damp[who]), lo[who], hi[who])
        used[who] += 1
        gain = cost[who] - loss(errors(made, who))
        better = gain > 0
        moved = who[better]
        x[moved], fresh[moved] = made[better], True
        damp[who] = np.where(better, damp[who] / 10, damp[who] * 10)
        who = who[(used[who] < EVALUATIONS) & (damp[who] < 1e12) & (~better | (gain > SETTLED * cost[who]))]
    return x, np.sqrt(np.mean(errors(x, np.arange(n)) ** 2, axis=1))


def refine_poses(gcps: DataFrame, by: str, k: tuple[float, float, float, float]) -> DataFrame:
    """POSE of each image that fits its control points (pixel_u, pixel_v, lat, lon) best,
    from the pose in its rows (cam_lat, cam_lon, height, heading, pitch, roll): damped
    steps within bounds under a loss that grows slower than squares.  A point or a pose
    with a null isn't used.  Images of fewer than LEAST_POSE points keep their pose, with
    a null rms.

    Images of equally many points are fitted together, FIT_POINTS at once: one by one
    their small arrays cost far more time than the arithmetic."""
    pose, told = ["cam_lon", "cam_lat", "height", "heading", "pitch", "roll"], ["pixel_u", "pixel_v", "lat", "lon"]
    names = [by, *(f.split()[0] for f in POSE.split(", "))]

    def fit(rows: pa.Table) -> pa.RecordBatch:
        """rows: whole images, sorted."""
        key = rows.column(by).combine_chunks()
        code = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        at = {n: rows.column(n).to_numpy().astype(float) for n in (*pose, *told)}
        x, rms = np.column_stack([at[n][first] for n in pose]), np.full(len(first), np.nan)
        points = np.stack([at[n] for n in told])
        used = np.isfinite(points).all(axis=0)
        count = np.add.reduceat(used.astype(int), first) * np.isfinite(x).all(axis=1)
        image = np.repeat(np.arange(len(first)), np.diff(first, append=len(code)))
        for n in np.unique(count[count >= LEAST_POSE]):
            who = np.flatnonzero(count == n)
            own = points[:, used & np.isin(image, who)].reshape(4, len(who), n)
            size = max(1, FIT_POINTS // n)
            for lo in range(0, len(who), size):
                part = who[lo : lo + size]
                x[part], rms[part] = _fit_poses(x[part], own[:, lo : lo + size], k)
        least = [-np.inf, -np.inf, 0.1, -360, -90, -180]
        x = np.clip(x, least, [np.inf, np.inf, 200, 360, 0, 180])
        return pa.RecordBatch.from_arrays([key.take(pa.array(first)), *(pa.array(c, from_pandas=True) for c in (x[:, 1], x[:, 0], *x[:, 2:].T, rms))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows that are not fitted yet, of which the last image may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            if held.num_rows >= FIT_POINTS:
                code = held.column(by).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                if end := int(np.flatnonzero(np.diff(code, prepend=-1))[-1]):
                    yield fit(held.slice(0, end))
                    held = held.slice(end)
        if held is not None:
            yield fit(held)

    # few rows but much work for each, so they are dealt out to all cores
    rows = gcps.select(c(by).cast("long").alias(by), *(c(n).cast("double").alias(n) for n in (*pose, *told)))
    return rows.repartition(gcps.sparkSession.sparkContext.defaultParallelism, by).sortWithinPartitions(by).mapInArrow(run, f"{by} long, {POSE}")
