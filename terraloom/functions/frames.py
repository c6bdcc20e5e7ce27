"""Frames that positions are given in, and diagnostics of a camera's geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def camera_centre(rotation: Sequence[Sequence[Column]], shift: Sequence[Column]) -> list[Column]:
    """Where a camera stands, -R'T, from the rotation and shift that take the world into it."""
    return [-(rotation[0][j] * shift[0] + rotation[1][j] * shift[1] + rotation[2][j] * shift[2]) for j in range(3)]


def local_to_map(x: Column, y: Column, z: Column, shift: Sequence[float]) -> list[Column]:
    return [v - s for v, s in zip((x, y, z), shift)]


def pixel_to_map(col: Column, row: Column, affine: Sequence[float]) -> tuple[Column, Column]:
    """Map position of a pixel; affine: a, b, c, d, e, f of x = a col + b row + c."""
    a, b, c0, d, e, f = affine
    return a * col + b * row + c0, d * col + e * row + f


def map_to_pixel(x: Column, y: Column, affine: Sequence[float], truncate: bool = False) -> tuple[Column, Column]:
    """Column and row of the cell that holds a position in a map without rotation:
    rounded down, or towards zero with ``truncate``."""
    a, _, c0, _, e, f = affine
    cut = (lambda v: v.cast("bigint")) if truncate else F.floor
    return cut((x - c0) / a), cut((y - f) / e)


def unscale_pixel(u: Column, v: Column, scale_x: float, scale_y: float) -> tuple[Column, Column]:
    return u / scale_x, v / scale_y


def to_y_up(east: Column, north: Column, up: Column) -> list[Column]:
    """East, north and up in a viewer's frame: x, y up, z towards the south."""
    return [east, up, -north]


def ray_diagnostics(east: Column, north: Column, up: Column, slant: Column) -> Column:
    """Horizontal distance, drop, and by how much a slant range disagrees with them."""
    flat = F.hypot(east, north)
    return F.struct(flat.alias("horizontal"), up.alias("dz"), F.abs(F.sqrt(flat * flat + up * up) - slant).alias("off"))


def board_geometry(us: Column, vs: Column, width: float, height: float) -> Column:
    """Share of the image that a board's corners span, its tilt from the axes in degrees
    (by its first and last corner), and its centre as shares of the image."""
    span = lambda x: F.array_max(x) - F.array_min(x)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    angle = F.degrees(F.atan2(F.abs(F.element_at(vs, -1) - vs[0]), F.abs(F.element_at(us, -1) - us[0])))
    return F.struct((span(us) * span(vs) / (width * height)).alias("coverage"), F.least(angle, 90 - angle).alias("tilt"), (mean(us) / width).alias("centre_x"), (mean(vs) / height).alias("centre_y"))
