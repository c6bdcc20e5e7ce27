"""Elevation grids of points, and poses above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def grid_max(points: DataFrame, x0: float, y1: float, cell: float, cols: int, rows: int) -> DataFrame:
    """row, col, z: the highest point of each cell, rows from the top; points outside
    the grid are left out."""
    at = points.select(F.floor((y1 - c("y")) / cell).alias("row"), F.floor((c("x") - x0) / cell).alias("col"), "z")
    return at.where((c("row") >= 0) & (c("row") < rows) & (c("col") >= 0) & (c("col") < cols)).groupBy("row", "col").agg(F.max("z").alias("z"))


def grid_max_clipped(points: DataFrame, x0: float, y0: float, cell: float, cols: int, rows: int) -> DataFrame:
    """row, col, z: the highest point of each cell, rows from the bottom; points outside
    count for the cell at the edge."""
    cut = lambda x, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), x.cast("bigint")))
    at = points.select(cut((c("y") - y0) / cell, rows).alias("row"), cut((c("x") - x0) / cell, cols).alias("col"), "z")
    return at.groupBy("row", "col").agg(F.max("z").alias("z"))


def above_grid(poses: DataFrame, cells: DataFrame, x0: float, y1: float, cell: float) -> DataFrame:
    """The poses (x, y, alt) with row, col, z of their cell and ``above``; null where the
    grid has no cell.  Rows and columns are cut towards zero, so a pose less than a cell
    to the left of the grid or above it counts for the cell at its edge."""
    at = poses.withColumns({"row": ((y1 - c("y")) / cell).cast("bigint"), "col": ((c("x") - x0) / cell).cast("bigint")})
    return at.join(cells, ["row", "col"], "left").withColumn("above", c("alt") - c("z"))
