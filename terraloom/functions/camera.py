"""Pinhole cameras: axes from heading, pitch and roll, rays, planes, intrinsics.

World: east, north, up.  Camera: right, down, forward.  Heading 0 is north and 90
east; pitch 0 is level and -90 straight down; positive roll tips the right side down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geodesy import enu_to_latlon, enu_to_latlon_arrays, reduced_latitude
from terraloom.functions.stages import dealt, staged

c = F.col
AXES = [f"{axis}_{d}" for axis in ("right", "down", "fwd") for d in "enu"]
#: Rolls below this many degrees count as level.
LEVEL = 1e-6
#: Pixels of a grid that are computed at once, about.
GRID_ROWS = 1 << 15


def camera_axes(df: DataFrame, heading: str = "heading", pitch: str = "pitch", roll: str = "roll") -> DataFrame:
    """Adds the nine entries of the world-to-camera rotation: AXES, row by row."""
    steps = [{"_sh": F.sin(F.radians(heading)), "_ch": F.cos(F.radians(heading)), "_sp": F.sin(F.radians(pitch)), "_cp": F.cos(F.radians(pitch)), "_sr": F.when(F.abs(roll) > LEVEL, F.sin(F.radians(roll))).otherwise(0.0), "_cr": F.when(F.abs(roll) > LEVEL, F.cos(F.radians(roll))).otherwise(1.0)}]
    # forward x level right is the level down axis
    steps.append({"fwd_e": c("_sh") * c("_cp"), "fwd_n": c("_ch") * c("_cp"), "fwd_u": c("_sp"), "_de": c("_sh") * c("_sp"), "_dn": c("_ch") * c("_sp"), "_du": -c("_cp")})
    steps.append({"right_e": c("_cr") * c("_ch") + c("_sr") * c("_de"), "right_n": -c("_cr") * c("_sh") + c("_sr") * c("_dn"), "right_u": c("_sr") * c("_du"), "down_e": c("_cr") * c("_de") - c("_sr") * c("_ch"), "down_n": c("_cr") * c("_dn") + c("_sr") * c("_sh"), "down_u": c("_cr") * c("_du")})
    return staged(df, steps, AXES)


def world_ray(df: DataFrame, u: str, v: str, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Adds ray_e, ray_n, ray_u: the unit world ray of a pixel, from AXES."""
    steps = [{"_x": (c(u) - cx) / fx, "_y": (c(v) - cy) / fy}]
    steps.append({"_n": F.sqrt(c("_x") * c("_x") + c("_y") * c("_y") + 1)})
    steps.append({f"ray_{d}": (c("_x") * c(f"right_{d}") + c("_y") * c(f"down_{d}") + c(f"fwd_{d}")) / c("_n") for d in "enu"})
    return staged(df, steps, ["ray_e", "ray_n", "ray_u"])


def flat_hit(df: DataFrame, height: str, east: str = "east", north: str = "north") -> DataFrame:
    """Adds where the ray meets the plane ``height`` below the camera; null if it doesn't:
    a ray along the plane (within 1e-9) or one that meets it behind."""
    far = F.when(F.abs(c("ray_u")) >= 1e-9, -c(height) / c("ray_u"))
    steps = [{"_any": far}, {"_far": F.when(c("_any") >= 0, c("_any"))}, {east: c("_far") * c("ray_e"), north: c("_far") * c("ray_n")}]
    return staged(df, steps, [east, north])


def prepare_cameras(cameras: DataFrame, lat: str = "cam_lat") -> DataFrame:
    """What depends on the camera only; joined to pixels it is computed once a camera."""
    return reduced_latitude(camera_axes(cameras), lat)


def pixels_to_ground(df: DataFrame, fx: float, fy: float, cx: float, cy: float, *, u: str = "u", v: str = "v", height: str = "height", cam_lat: str = "cam_lat", cam_lon: str = "cam_lon", on_miss: str = "null") -> DataFrame:
    """Adds lat and lon of pixels on flat ground, for rows with prepared cameras.

    on_miss: ``null`` keeps pixels at or above the horizon with null positions, ``drop``
    leaves them out, ``error`` raises.
    """
    df = flat_hit(world_ray(df, u, v, fx, fy, cx, cy), height, "_east", "_north")
    if on_miss == "drop":  # here, as a filter above the geodesic would repeat its whole chain
        df = df.where("_east IS NOT NULL")
    df = enu_to_latlon(df, "_east", "_north", cam_lat, cam_lon)
    df = df.drop("_east", "_north", "ray_e", "ray_n", "ray_u", *AXES)
    if on_miss == "error":
        return df.withColumn("lat", F.coalesce("lat", F.raise_error(F.lit("a pixel's ray doesn't meet the ground")).cast("double")))
    return df


def grid_to_ground(cameras: DataFrame, by: str, width: int, height: int, step: int, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """``by``, u, v, lat and lon of every prepared camera's pixels at each ``step`` that
    meet flat ground, as pixel_grid and pixels_to_ground give them.

    A camera is one row and becomes hundreds: cameras are dealt out to all cores, as a
    table of one small file would be one task, and only they go to Python, where their
    pixels are arrays of about GRID_ROWS.  A camera with a null in its pose hits nothing."""
    names = ["height", "cam_lon", "_sin_u", "_cos_u", *AXES]
    own = cameras.select(by, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, u = (x.ravel() for x in np.meshgrid(np.arange(0, height, step, dtype=float), np.arange(0, width, step, dtype=float), indexing="ij"))
        at_once = max(1, GRID_ROWS // len(u))
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                c = {n: part.column(n).to_numpy(zero_copy_only=False).astype(float)[:, None] for n in names}
                for p in range(0, len(u), GRID_ROWS):
                    x, y = (u[p : p + GRID_ROWS] - cx) / fx, (v[p : p + GRID_ROWS] - cy) / fy
                    n = np.sqrt(x * x + y * y + 1)
                    ray = {d: (x * c[f"right_{d}"] + y * c[f"down_{d}"] + c[f"fwd_{d}"]) / n for d in "enu"}
                    with np.errstate(divide="ignore", invalid="ignore"):
                        far = np.where(np.abs(ray["u"]) >= 1e-9, -c["height"] / ray["u"], np.nan)
                        row, k = np.nonzero(far >= 0)
                    far = far[row, k]
                    lat, lon = enu_to_latlon_arrays(far * ray["e"][row, k], far * ray["n"][row, k], *(c[f][row, 0] for f in ("_sin_u", "_cos_u", "cam_lon")))
                    yield pa.RecordBatch.from_arrays([part.column(by).take(pa.array(row)), *map(pa.array, (u[p + k], v[p + k], lat, lon))], [by, "u", "v", "lat", "lon"])

    return dealt(own).mapInArrow(run, f"{by} {own.schema[by].dataType.simpleString()}, u double, v double, lat double, lon double")


def scaled(f: float | Column, size: Column, calibrated: float | Column) -> Column:
    """A focal length or principal coordinate for another image size."""
    return f * size / calibrated


def nominal_focal(width: Column, sensor_mm: float, focal_mm: float) -> Column:
    return focal_mm / sensor_mm * width


def ground_sample(height: Column, pitch: Column, f: float | Column) -> Column:
    """Metres of ground for a pixel at the image centre; infinite for a level camera."""
    return F.when(F.sin(F.abs(F.radians(pitch))) > 0, height / F.sin(F.abs(F.radians(pitch))) / f).otherwise(float("inf"))


def project_point(df: DataFrame, x: str, y: str, z: str, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """Adds u, v and inside for points in the camera's frame; null behind the camera."""
    steps = [{"u": F.when(c(z) > 0, c(x) / c(z) * fx + cx), "v": F.when(c(z) > 0, c(y) / c(z) * fy + cy)}]
    steps.append({"inside": F.coalesce((c("u") >= 0) & (c("u") < width) & (c("v") >= 0) & (c("v") < height), F.lit(False))})
    return staged(df, steps, ["u", "v", "inside"])


def undistort_point(df: DataFrame, u: str, v: str, fx: float, fy: float, cx: float, cy: float, d: list[float], steps_: int = 5) -> DataFrame:
    """Adds und_u, und_v: the pixel without lens distortion (k1, k2, p1, p2, k3), by
    fixed-point iteration."""
    k1, k2, p1, p2, k3 = d
    steps: list[dict[str, Column]] = [{"_x0": (c(u) - cx) / fx, "_y0": (c(v) - cy) / fy}, {"_x": c("_x0"), "_y": c("_y0")}]
    for _ in range(steps_):
        steps.append({"_r2": c("_x") * c("_x") + c("_y") * c("_y"), "_xy": c("_x") * c("_y")})
        steps.append({"_rad": 1 + c("_r2") * (k1 + c("_r2") * (k2 + c("_r2") * k3)), "_dx": 2 * p1 * c("_xy") + p2 * (c("_r2") + 2 * c("_x") * c("_x")), "_dy": p1 * (c("_r2") + 2 * c("_y") * c("_y")) + 2 * p2 * c("_xy")})
        steps.append({"_x": (c("_x0") - c("_dx")) / c("_rad"), "_y": (c("_y0") - c("_dy")) / c("_rad")})
    steps.append({"und_u": c("_x") * fx + cx, "und_v": c("_y") * fy + cy})
    return staged(df, steps, ["und_u", "und_v"])


def plane_hit_euler(df: DataFrame, ground_z: float | Column) -> DataFrame:
    """The older convention: radians, camera x forward axes turned by Rz(yaw) Ry(pitch)
    Rx(roll), from (cam_x, cam_y, cam_z) along (ray_x, ray_y, ray_z) to a level plane.
    Adds hit_x, hit_y; null for a parallel ray (1e-6) or a plane behind."""
    sy, cy_, sp, cp, sr, cr = (f(c(a)) for a in ("yaw", "pitch", "roll") for f in (F.sin, F.cos))
    x, y, z = c("ray_x"), c("ray_y"), c("ray_z")
    steps = [{"_wx": cy_ * cp * x + (cy_ * sp * sr - sy * cr) * y + (cy_ * sp * cr + sy * sr) * z, "_wy": sy * cp * x + (sy * sp * sr + cy_ * cr) * y + (sy * sp * cr - cy_ * sr) * z, "_wz": -sp * x + cp * sr * y + cp * cr * z}]
    steps.append({"_t": F.when(F.abs(c("_wz")) >= 1e-6, (ground_z - c("cam_z")) / c("_wz"))})
    steps.append({"_t": F.when(c("_t") > 0, c("_t"))})
    steps.append({"hit_x": c("cam_x") + c("_t") * c("_wx"), "hit_y": c("cam_y") + c("_t") * c("_wy")})
    return staged(df, steps, ["hit_x", "hit_y"])
