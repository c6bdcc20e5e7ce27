"""Terrain as a table of cells: lookups, fallbacks and where rays meet it.

A terrain is cells (row, col, z) of a grid (``Grid``: its left and top edge, cell size,
columns and rows), rows from the top; a cell that isn't there has no data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: A grid of at most so many cells (8 bytes each) goes to every executor.
BROADCAST_CELLS = 10_000_000
#: Rays of one tile that a task takes, about.
RAYS_A_TASK = 100_000
HITS = "ray_id long, t_lo double, t_hi double, t double, east double, north double, elev double"


@dataclass(frozen=True)
class Grid:
    x0: float
    y1: float
    cell: float
    cols: int
    rows: int

    def place(self, x, y, truncate: bool = False):
        """Row and column of a position, as Columns; towards zero with ``truncate``."""
        cut = (lambda v: v.cast("bigint")) if truncate else F.floor
        return cut((self.y1 - y) / self.cell), cut((x - self.x0) / self.cell)


def sample(points: DataFrame, cells: DataFrame, grid: Grid, x: str = "x", y: str = "y", truncate: bool = False) -> DataFrame:
    """The points with row, col and z of their cell; z is null where there is no data."""
    row, col = grid.place(c(x), c(y), truncate)
    return points.withColumns({"row": row, "col": col}).join(cells, ["row", "col"], "left")


def sample_first(points: DataFrame, tiles: list[tuple[DataFrame, Grid]], point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """The points with z of the first of several tiles that has it, and which one it was."""
    found = points
    for k, (cells, grid) in enumerate(tiles):
        row, col = grid.place(c(x), c(y))
        own = cells.select(c("row").alias("_r"), c("col").alias("_c"), c("z").alias(f"_z{k}"))
        found = found.withColumns({"_r": row, "_c": col}).join(own, ["_r", "_c"], "left").drop("_r", "_c")
    pick = F.coalesce(*(F.when(c(f"_z{k}").isNotNull(), F.struct(c(f"_z{k}").alias("z"), F.lit(k).alias("tile"))) for k in range(len(tiles))))
    return found.withColumn("_p", pick).select(*points.columns, "_p.z", "_p.tile")


def ladder(df: DataFrame, *steps: tuple[str, str]) -> DataFrame:
    """Adds ``mode`` and ``found``: the name and the column's value of the first step
    (name, column) that has one."""
    told = F.coalesce(*(F.when(c(col).isNotNull(), F.struct(F.lit(name).alias("mode"), c(col).alias("found"))) for name, col in steps))
    return df.withColumn("_l", told).select(*df.columns, "_l.mode", "_l.found")


@dataclass(frozen=True)
class March:
    """How a ray is followed.  ``start``: first sample, in steps; ``above``: the sample
    before a crossing must lie above the ground; ``reset``: a sample without data is
    forgotten together with what came before; ``loose``: the bracket opens one step
    before the crossing, else at the last sample with data; ``halvings`` of it follow."""

    step: float
    reach: float
    start: int
    above: bool
    reset: bool
    loose: bool
    halvings: int
    tolerance: float = 0.0
    width: float = 0.0


#: The three marches.
MARCHES = {
    "a": March(0.5, 5000.0, 0, above=True, reset=False, loose=False, halvings=50, tolerance=0.2, width=1e-4),
    "b": March(1.0, 500.0, 1, above=False, reset=False, loose=True, halvings=8),
    "c": March(1.0, 500.0, 1, above=False, reset=True, loose=True, halvings=8),
}
EPSILON = 1e-5


class Surface:
    def __init__(self, grid: Grid, row: np.ndarray, col: np.ndarray, z: np.ndarray, top: int = 0, left: int = 0, rows: int | None = None, cols: int | None = None):
        self.grid, self.top, self.left = grid, top, left
        self.z = np.full((grid.rows if rows is None else rows, grid.cols if cols is None else cols), np.nan)
        self.z[row - top, col - left] = z

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Elevation of positions; NaN without data."""
        row = np.floor((self.grid.y1 - y) / self.grid.cell) - self.top
        col = np.floor((x - self.grid.x0) / self.grid.cell) - self.left
        inside = (row >= 0) & (row < self.z.shape[0]) & (col >= 0) & (col < self.z.shape[1])
        out = np.full(len(x), np.nan)
        out[inside] = self.z[row[inside].astype(np.int64), col[inside].astype(np.int64)]
        return out

    def last_step(self, rays: pd.DataFrame, m: March) -> np.ndarray:
        """Steps after which a ray has left the grid for good."""
        left, top = self.grid.x0 + self.left * self.grid.cell, self.grid.y1 - self.top * self.grid.cell
        box = ((rays.e0, rays.de, left, left + self.z.shape[1] * self.grid.cell), (rays.n0, rays.dn, top - self.z.shape[0] * self.grid.cell, top))
        end = np.full(len(rays), m.reach)
        for at, d, lo, hi in box:
            at, d = at.to_numpy(float), d.to_numpy(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(d > 0, (hi - at) / d, np.where(d < 0, (lo - at) / d, np.where((at >= lo) & (at <= hi), np.inf, -1)))
            end = np.minimum(end, out)
        return np.floor(np.clip(end + m.step, -1, m.reach) / m.step)

    def meet(self, rays: pd.DataFrame, m: March) -> pd.DataFrame:
        """HITS of rays (ray_id, e0, n0, z0, de, dn, du); all rays take a step at once."""
        e0, n0, z0, de, dn, du = (rays[k].to_numpy(float) for k in ("e0", "n0", "z0", "de", "dn", "du"))
        gap = lambda i, t: z0[i] + t * du[i] - self.at(e0[i] + t * de[i], n0[i] + t * dn[i])
        last = self.last_step(rays, m)
        before, since = np.full(len(rays), np.nan), np.zeros(len(rays))
        lo, hi = np.full(len(rays), np.nan), np.full(len(rays), np.nan)
        live = np.arange(len(rays))
        k = m.start
        while len(live := live[last[live] >= k]):
            t = k * m.step
            g = gap(live, t)
            ok = ~np.isnan(g)
            down = ok & (g <= EPSILON) & (before[live] > 0) if m.above else ok & (g <= 0) & ~np.isnan(before[live])
            hit = live[down]
            lo[hit], hi[hit] = (t - m.step) if m.loose else since[hit], t
            if m.reset:
                before[live] = g
            else:
                before[live[ok]] = g[ok]
            since[live[ok]] = t
            live = live[~down]
            k += 1
        i = np.flatnonzero(~np.isnan(hi))
        a, b = lo[i].copy(), hi[i].copy()
        t = self._narrow(gap, i, a, b, m)
        out = pd.DataFrame({"ray_id": rays.ray_id.to_numpy()[i], "t_lo": lo[i], "t_hi": hi[i], "t": t})
        out["east"], out["north"] = e0[i] + t * de[i], n0[i] + t * dn[i]
        ground = self.at(out.east.to_numpy(), out.north.to_numpy())
        out["elev"] = np.where(np.isnan(ground), z0[i] + t * du[i], ground)
        return out

    @staticmethod
    def _narrow(gap, i: np.ndarray, a: np.ndarray, b: np.ndarray, m: March) -> np.ndarray:
        """Where in (a, b) each ray meets the ground, by halving."""
        told = np.full(len(i), np.nan)
        open_ = np.ones(len(i), bool)
        for _ in range(m.halvings):
            open_ &= ~(b - a < m.width) & np.isnan(told)
            j = np.flatnonzero(open_)
            if not len(j):
                break
            mid = 0.5 * (a[j] + b[j])
            g = gap(i[j], mid)
            if m.above:  # a middle without data is tried again nearer the far end
                lost = np.isnan(g)
                mid[lost] = a[j[lost]] + 0.75 * (b[j[lost]] - a[j[lost]])
                g[lost] = gap(i[j[lost]], mid[lost])
            open_[j[np.isnan(g)]] = False
            near = np.abs(g) < m.tolerance
            told[j[near]] = mid[near]
            over = (g > 0) & ~near
            a[j[over]] = mid[over]
            under = (g <= 0) & ~near
            b[j[under]] = mid[under]
        if not m.above:
            return b
        middle = 0.5 * (a + b)
        rest = np.where(np.isnan(gap(i, middle)), b, middle)
        return np.where(np.isnan(told), rest, told)


def first_crossings(rays: DataFrame, cells: DataFrame, grid: Grid, march: str | March = "a") -> DataFrame:
    """HITS: where each ray (ray_id; position e0, n0, z0; unit direction de, dn, du) first
    meets the terrain, at which distance t, and the samples about it; rays that don't
    meet it give no row.

    A grid of up to BROADCAST_CELLS cells goes to all executors.  A larger one is dealt
    out by tiles of the march's reach, each with the tiles about it, and so are the rays,
    those of a crowded tile in several parts."""
    m = MARCHES[march] if isinstance(march, str) else march
    names = ["ray_id", "e0", "n0", "z0", "de", "dn", "du"]
    rays = rays.select(*names)
    if grid.rows * grid.cols <= BROADCAST_CELLS:
        inside = cells.where(c("row").between(0, grid.rows - 1) & c("col").between(0, grid.cols - 1))
        table = inside.select("row", "col", "z").toPandas()  # at most rows x cols
        known = rays.sparkSession.sparkContext.broadcast(Surface(grid, *(table[k].to_numpy() for k in ("row", "col", "z"))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield known.value.meet(pdf, m)

        return rays.mapInPandas(run, HITS)

    size = max(1, int(np.ceil(m.reach / grid.cell)))  # cells along a tile
    row, col = grid.place(c("e0"), c("n0"))
    rays = rays.withColumns({"ti": F.floor(row / size), "tj": F.floor(col / size)})
    parts = rays.groupBy("ti", "tj").agg(F.ceil(F.count("*") / RAYS_A_TASK).alias("parts"))
    rays = rays.join(F.broadcast(parts), ["ti", "tj"]).withColumn("part", F.pmod(F.xxhash64("ray_id"), c("parts"))).drop("parts")
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = cells.select("row", "col", "z", F.floor(c("row") / size).alias("ti"), F.floor(c("col") / size).alias("tj")).withColumn("_i", near).withColumn("_j", near)
    spread = spread.withColumns({"ti": c("ti") + c("_i"), "tj": c("tj") + c("_j")}).drop("_i", "_j").join(F.broadcast(parts), ["ti", "tj"])
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), c("parts") - 1))).drop("parts")

    def one(key: tuple, own: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ground.empty:
            return pd.DataFrame({x.split()[0]: [] for x in HITS.split(", ")})
        top, left = int((key[0] - 1) * size), int((key[1] - 1) * size)
        return Surface(grid, *(ground[k].to_numpy() for k in ("row", "col", "z")), top, left, 3 * size, 3 * size).meet(own, m)

    keys = ["ti", "tj", "part"]
    return rays.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(one, HITS)
