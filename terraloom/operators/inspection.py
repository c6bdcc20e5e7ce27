"""Verdicts on calibration images, elevation models, outliers and data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: Bounds of a calibration image's measures.
SHARPNESS_MIN, BRIGHTNESS, COVERAGE, TILT_MIN, REPROJ_MAX = 100.0, (40.0, 220.0), (0.05, 0.90), 5.0, 1.5
GRID_SIZE, MIN_CELLS, MIN_TILT_RANGE = 3, 4, 10.0


def verdicts(images: DataFrame) -> DataFrame:
    """Adds pass_* for each gate, ``reasons`` (names of failed gates) and ``selected``.
    Board gates hold only where corners were found; without them only that fails."""
    found = c("corners_found")
    gates = {
        "sharpness": c("sharpness") >= SHARPNESS_MIN,
        "exposure": c("brightness").between(*BRIGHTNESS),
        "corners": found,
        "coverage": ~found | c("coverage").between(*COVERAGE),
        "tilt": ~found | (c("tilt_deg") >= TILT_MIN),
        "reproj": c("reproj_error") <= REPROJ_MAX,
    }
    gates = {k: F.coalesce(g, F.lit(False)) for k, g in gates.items()}
    reasons = F.array_compact(F.array(*(F.when(~c(f"pass_{k}"), k) for k in gates)))
    df = images.withColumns({f"pass_{k}": g for k, g in gates.items()}).withColumn("reasons", reasons)
    return df.withColumn("selected", F.size("reasons") == 0)


def report_columns() -> list[Column]:
    """The report's columns as text: fixed decimals, reasons joined by semicolons."""
    decimals = {"sharpness": 1, "brightness": 1, "coverage": 4, "tilt_deg": 2, "reproj_error": 4}
    numbers = [F.format_string(f"%.{d}f", k).alias(k) for k, d in decimals.items()]
    return [c("image_id").cast("string").alias("image_id"), *numbers, F.when(c("selected"), "yes").otherwise("no").alias("selected"), F.concat_ws("; ", "reasons").alias("reject_reasons")]


def report_line() -> Column:
    return F.concat_ws(",", *report_columns())


def diversity(judged: DataFrame, by: str) -> DataFrame:
    """For each group's selected images: cells of the frame that boards are in, whether
    one is at the edge, the range of tilts, and which of three warnings hold."""
    cell = lambda x: F.least(F.lit(GRID_SIZE - 1), (c(x) * GRID_SIZE).cast("int"))
    df = judged.where("selected").withColumns({"_x": cell("board_x"), "_y": cell("board_y")})
    edge = c("_x").isin(0, GRID_SIZE - 1) | c("_y").isin(0, GRID_SIZE - 1)
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("_x", "_y").alias("cells"), F.bool_or(edge).alias("at_edge"), (F.max("tilt_deg") - F.min("tilt_deg")).alias("tilt_range"))
    return out.withColumns({"few_cells": c("cells") < MIN_CELLS, "no_edge": ~c("at_edge"), "narrow_tilt": c("tilt_range") < MIN_TILT_RANGE})


def rejections(judged: DataFrame) -> DataFrame:
    """How often each gate failed."""
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def sufficiency(judged: DataFrame, by: str) -> DataFrame:
    """Selected and rejected images of each group, and whether they suffice."""
    out = judged.groupBy(by).agg(F.count_if("selected").alias("selected"), F.count_if(~c("selected")).alias("rejected"))
    return out.withColumn("tier", F.when(c("selected") < 6, "too few").when(c("selected") < 15, "usable").otherwise("good"))


def pixel_rms(df: DataFrame, by: str, dx: Column, dy: Column) -> DataFrame:
    """Reprojection error by two definitions: over single coordinates, and over points."""
    return df.groupBy(by).agg(F.sqrt(F.sum(dx * dx + dy * dy) / (2 * F.count(dx))).alias("rms_scalar"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("rms_point"))


def dsm_checks(cells: DataFrame, heights: DataFrame, rows: int, cols: int, resolution: float, expected: float, epsg: int, expected_epsg: int, z_min: float = 100.0, z_max: float = 125.0) -> DataFrame:
    """check, passed, detail: the seven checks of an elevation model.  cells: row, col, z;
    heights: pose_id and above (null outside the grid)."""
    stats = cells.agg(F.count("z").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    posed = heights.agg(F.count("above").alias("posed"), F.count_if(c("above") < 0).alias("below"), F.median("above").alias("median"), F.min(F.when(c("above") < 0, c("pose_id"))).alias("offender"))
    one = stats.join(F.broadcast(posed))  # a row each
    number = lambda x, d=2: F.format_string(f"%.{d}f", x)
    checks = [
        ("crs", F.lit(epsg == expected_epsg), F.lit(f"EPSG:{epsg}")),
        ("resolution", F.lit(abs(resolution - expected) < 1e-6), F.lit(f"{resolution:.4f}")),
        ("z_min", c("lo") > z_min, number("lo")),
        ("z_max", c("hi") < z_max, number("hi")),
        ("valid_cells", c("n") > 0, F.concat(c("n").cast("string"), F.lit(f" of {rows * cols}"))),
        ("above_surface", c("below") == 0, F.concat(c("below").cast("string"), F.lit(" below, first "), F.coalesce(c("offender").cast("string"), F.lit("none")))),
        ("median_height", c("median").between(0.5, 10.0), number("median")),
    ]
    rows_ = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), F.coalesce(d, F.lit("none")).alias("detail")) for k, ok, d in checks))
    return one.select(F.explode(rows_).alias("r")).select("r.*")


def height_stats(heights: DataFrame) -> DataFrame:
    """Median and range of heights above the surface, and counts by place."""
    return heights.agg(F.median("above").alias("median"), F.min("above").alias("lowest"), F.max("above").alias("highest"), F.count_if(c("above") < 0).alias("below"), F.count_if(c("above").isNull()).alias("outside"))


def without_outliers(df: DataFrame, by: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows whose value is below their group's median plus ``sigmas`` standard deviations."""
    bound = df.groupBy(by).agg((F.median(value) + sigmas * F.stddev_pop(value)).alias("_bound"))
    return df.join(bound, by).where(c(value) < c("_bound")).drop("_bound")


def extents(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(f(x).alias(f"{x}_{n}") for x in columns for n, f in (("min", F.min), ("max", F.max))))


def describe(df: DataFrame, value: str, nodata: float | None = None) -> DataFrame:
    """Count, share of valid cells and range of a terrain's values, all cells read."""
    ok = c(value).isNotNull() & ~F.isnan(value) & (F.lit(True) if nodata is None else c(value) != nodata)
    v = F.when(ok, c(value))
    return df.agg(F.count("*").alias("cells"), F.count(v).alias("valid"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"))


def sharpness(pixels: DataFrame, by: str) -> DataFrame:
    """Variance of the Laplacian and mean of grey pixels (by, x, y, v).  At the border
    the pixel inside is taken for the one that isn't there, as mirrored borders do."""
    along = lambda part, order: Window.partitionBy(by, part).orderBy(order)
    row, col = along("y", "x"), along("x", "y")
    beside = lambda w: (F.lag("v").over(w), F.lead("v").over(w))
    df = pixels
    for k, w in (("h", row), ("w", col)):
        a, b = beside(w)
        df = df.withColumns({f"_{k}a": a, f"_{k}b": b})
    both = lambda k: F.coalesce(f"_{k}a", f"_{k}b", "v") + F.coalesce(f"_{k}b", f"_{k}a", "v")
    return df.withColumn("_l", both("h") + both("w") - 4 * c("v")).groupBy(by).agg(F.var_pop("_l").alias("sharpness"), F.avg("v").alias("brightness"))
