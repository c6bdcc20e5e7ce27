"""Positions on the WGS84 ellipsoid: azimuthal-equidistant plane, UTM, great circle.

The azimuthal-equidistant projection about a point keeps distance and azimuth from
it, so its inverse is the direct geodesic problem and its forward the inverse one.
Both are solved by Vincenty's series, with a fixed number of steps: three change less
than a nanometre within 5 km.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.stages import staged

#: WGS84.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
EP2 = (A * A - B * B) / (B * B)
STEPS_DIRECT, STEPS_INVERSE = 3, 4
c = F.col


def _series(u2: Column) -> tuple[Column, Column]:
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big_a, big_b


def _delta(big_b: Column, sin_s: Column, cos_s: Column, cos_m: Column) -> Column:
    inner = cos_s * (-1 + 2 * cos_m * cos_m) - big_b / 6 * cos_m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * cos_m * cos_m)
    return big_b * sin_s * (cos_m + big_b / 4 * inner)


def reduced_latitude(df: DataFrame, lat: str) -> DataFrame:
    """Adds _sin_u and _cos_u, which depend on the origin only; do it before a join."""
    return staged(df, [{"_u": F.atan((1 - FLAT) * F.tan(F.radians(lat)))}, {"_sin_u": F.sin("_u"), "_cos_u": F.cos("_u")}], ["_sin_u", "_cos_u"])


def enu_to_latlon(df: DataFrame, east: str, north: str, lat0: str, lon0: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds ``lat`` and ``lon`` of the point east and north of an origin; null stays null."""
    if "_sin_u" not in df.columns:
        df = reduced_latitude(df, lat0)
    steps = [{"_s": F.sqrt(c(east) * c(east) + c(north) * c(north))}]
    steps.append({"_sa": F.when(c("_s") > 0, c(east) / c("_s")).otherwise(F.when(c("_s").isNotNull(), 0.0)), "_ca": F.when(c("_s") > 0, c(north) / c("_s")).otherwise(F.when(c("_s").isNotNull(), 1.0))})
    steps.append({"_sal": c("_cos_u") * c("_sa"), "_two_s1": 2 * F.atan2(c("_sin_u"), c("_cos_u") * c("_ca"))})
    steps.append({"_c2": 1 - c("_sal") * c("_sal")})
    steps.append({"_u2": c("_c2") * EP2})
    big_a, big_b = _series(c("_u2"))
    steps.append({"_first": c("_s") / (B * big_a), "_bb": big_b})
    sigma = "_first"
    for k in range(STEPS_DIRECT):
        steps.append({f"_ss{k}": F.sin(sigma), f"_cs{k}": F.cos(sigma), f"_cm{k}": F.cos(c("_two_s1") + c(sigma))})
        steps.append({f"_sig{k}": c("_first") + _delta(c("_bb"), c(f"_ss{k}"), c(f"_cs{k}"), c(f"_cm{k}"))})
        sigma = f"_sig{k}"
    steps.append({"_ss": F.sin(sigma), "_cs": F.cos(sigma), "_cm": F.cos(c("_two_s1") + c(sigma))})
    steps.append({"_up": c("_sin_u") * c("_cs") + c("_cos_u") * c("_ss") * c("_ca"), "_w": c("_sin_u") * c("_ss") - c("_cos_u") * c("_cs") * c("_ca"), "_lam": F.atan2(c("_ss") * c("_sa"), c("_cos_u") * c("_cs") - c("_sin_u") * c("_ss") * c("_ca")), "_cc": FLAT / 16 * c("_c2") * (4 + FLAT * (4 - 3 * c("_c2")))})
    turn = c(sigma) + c("_cc") * c("_ss") * (c("_cm") + c("_cc") * c("_cs") * (-1 + 2 * c("_cm") * c("_cm")))
    steps.append({lat: F.degrees(F.atan2(c("_up"), (1 - FLAT) * F.sqrt(c("_sal") * c("_sal") + c("_w") * c("_w")))), lon: c(lon0) + F.degrees(c("_lam") - (1 - c("_cc")) * FLAT * c("_sal") * turn)})
    return staged(df, steps, [lat, lon]).drop("_sin_u", "_cos_u")


def enu_to_latlon_arrays(east: np.ndarray, north: np.ndarray, sin_u: np.ndarray, cos_u: np.ndarray, lon0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lat and lon as ``enu_to_latlon`` gives them, of arrays, from the origins' reduced
    latitude and longitude."""
    s = np.sqrt(east * east + north * north)
    near = s == 0
    far = np.where(near, 1.0, s)
    sa, ca = np.where(near, 0.0, east / far), np.where(near, 1.0, north / far)
    sal, two_s1 = cos_u * sa, 2 * np.arctan2(sin_u, cos_u * ca)
    c2 = 1 - sal * sal
    big_a, big_b = _series(c2 * EP2)
    sigma = first = s / (B * big_a)
    for _ in range(STEPS_DIRECT):
        sigma = first + _delta(big_b, np.sin(sigma), np.cos(sigma), np.cos(two_s1 + sigma))
    ss, cs, cm = np.sin(sigma), np.cos(sigma), np.cos(two_s1 + sigma)
    w = sin_u * ss - cos_u * cs * ca
    cc = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
    turn = sigma + cc * ss * (cm + cc * cs * (-1 + 2 * cm * cm))
    lat = np.arctan2(sin_u * cs + cos_u * ss * ca, (1 - FLAT) * np.sqrt(sal * sal + w * w))
    lam = np.arctan2(ss * sa, cos_u * cs - sin_u * ss * ca)
    return np.degrees(lat), lon0 + np.degrees(lam - (1 - cc) * FLAT * sal * turn)


def latlon_to_enu(df: DataFrame, lat: str, lon: str, lat0: str, lon0: str, east: str = "east", north: str = "north") -> DataFrame:
    """Adds ``east`` and ``north`` of a position in the plane about an origin."""
    steps = [{"_u1": F.atan((1 - FLAT) * F.tan(F.radians(lat0))), "_u2l": F.atan((1 - FLAT) * F.tan(F.radians(lat))), "_l": F.radians(c(lon) - c(lon0))}]
    steps.append({"_s1": F.sin("_u1"), "_c1": F.cos("_u1"), "_s2": F.sin("_u2l"), "_c2": F.cos("_u2l"), "_lam0": c("_l")})
    for k in range(STEPS_INVERSE + 1):
        steps.append({f"_sl{k}": F.sin(f"_lam{k}"), f"_cl{k}": F.cos(f"_lam{k}")})
        steps.append({f"_x{k}": c("_c2") * c(f"_sl{k}"), f"_y{k}": c("_c1") * c("_s2") - c("_s1") * c("_c2") * c(f"_cl{k}")})
        steps.append({f"_ss{k}": F.sqrt(c(f"_x{k}") * c(f"_x{k}") + c(f"_y{k}") * c(f"_y{k}")), f"_cs{k}": c("_s1") * c("_s2") + c("_c1") * c("_c2") * c(f"_cl{k}")})
        steps.append({f"_sig{k}": F.atan2(f"_ss{k}", f"_cs{k}"), f"_sa{k}": F.when(c(f"_ss{k}") > 0, c("_c1") * c("_c2") * c(f"_sl{k}") / c(f"_ss{k}")).otherwise(0.0)})
        steps.append({f"_ca{k}": 1 - c(f"_sa{k}") * c(f"_sa{k}")})
        steps.append({f"_cm{k}": F.when(c(f"_ca{k}") > 1e-12, c(f"_cs{k}") - 2 * c("_s1") * c("_s2") / c(f"_ca{k}")).otherwise(0.0), f"_cc{k}": FLAT / 16 * c(f"_ca{k}") * (4 + FLAT * (4 - 3 * c(f"_ca{k}")))})
        if k < STEPS_INVERSE:
            turn = c(f"_sig{k}") + c(f"_cc{k}") * c(f"_ss{k}") * (c(f"_cm{k}") + c(f"_cc{k}") * c(f"_cs{k}") * (-1 + 2 * c(f"_cm{k}") * c(f"_cm{k}")))
            steps.append({f"_lam{k + 1}": c("_l") + (1 - c(f"_cc{k}")) * FLAT * c(f"_sa{k}") * turn})
    k = STEPS_INVERSE
    big_a, big_b = _series(c("_w2"))
    steps.append({"_w2": c(f"_ca{k}") * EP2})
    steps.append({"_dist": B * big_a * (c(f"_sig{k}") - _delta(big_b, c(f"_ss{k}"), c(f"_cs{k}"), c(f"_cm{k}")))})
    unit = lambda x: F.when(c(f"_ss{k}") > 0, c("_dist") * c(x) / c(f"_ss{k}")).otherwise(F.when(c("_dist").isNotNull(), 0.0))
    steps.append({east: unit(f"_x{k}"), north: unit(f"_y{k}")})
    return staged(df, steps, [east, north])


def enu_to_latlon_sphere(east: Column, north: Column, lat0: Column, lon0: Column, radius: float = 6_371_000.0) -> tuple[Column, Column]:
    """The viewers' small-angle form on a sphere; it isn't the ellipsoid's projection."""
    lat = lat0 + F.degrees(north / radius)
    return lat, lon0 + F.degrees(east / (radius * F.cos(F.radians(lat0))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def utm(df: DataFrame, lat: str, lon: str, zone: int, x: str = "x", y: str = "y", south: bool = False) -> DataFrame:
    """Adds easting and northing in a UTM zone, by Krueger's series to the fourth order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    k0, e, middle = 0.9996, 2 * math.sqrt(n) / (1 + n), 6 * zone - 183
    steps = [{"_sp": F.sin(F.radians(lat)), "_dl": F.radians(c(lon) - middle)}]
    steps.append({"_t": F.sinh(F.atanh("_sp") - e * F.atanh(e * c("_sp")))})
    steps.append({"_xi": F.atan2(c("_t"), F.cos("_dl")), "_eta": F.atanh(F.sin("_dl") / F.sqrt(1 + c("_t") * c("_t")))})
    xi, eta = c("_xi"), c("_eta")
    for j, a in enumerate(alpha, 1):
        xi = xi + a * F.sin(2 * j * c("_xi")) * F.cosh(2 * j * c("_eta"))
        eta = eta + a * F.cos(2 * j * c("_xi")) * F.sinh(2 * j * c("_eta"))
    steps.append({x: 500_000 + k0 * radius * eta, y: (10_000_000 if south else 0) + k0 * radius * xi})
    return staged(df, steps, [x, y])
