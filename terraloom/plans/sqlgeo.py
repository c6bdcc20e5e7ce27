"""DuckDB SQL of the geometry kernels, as chains of common table expressions."""

from __future__ import annotations

A, B = 6378137.0, 6378137.0 * (1 - 1 / 298.257223563)
F = 1 / 298.257223563
EP2 = (A * A - B * B) / (B * B)


def chain(name: str, source: str, steps: list[str]) -> str:
    """name AS (...): ``source`` with each step's columns added in turn."""
    parts, at = [], source
    for i, step in enumerate(steps):
        own = name if i == len(steps) - 1 else f"{name}_{i}"
        parts.append(f"{own} AS (SELECT *, {step} FROM {at})")
        at = own
    return ",\n".join(parts)


def rotation(name: str, source: str) -> str:
    return chain(name, source, [
        "radians(heading) AS hh, radians(pitch) AS pp, CASE WHEN abs(roll) > 1e-6 THEN radians(roll) ELSE 0e0 END AS rr",
        "sin(hh)*cos(pp) AS fe, cos(hh)*cos(pp) AS fn, sin(pp) AS fu",
        "cos(rr)*cos(hh) + sin(rr)*(fn*0 - fu*(-sin(hh))) AS re, cos(rr)*(-sin(hh)) + sin(rr)*(fu*cos(hh) - fe*0) AS rn, sin(rr)*(fe*(-sin(hh)) - fn*cos(hh)) AS ru",
        "fn*ru - fu*rn AS de, fu*re - fe*ru AS dn, fe*rn - fn*re AS du",
    ])


def ray(name: str, source: str, fx: float, fy: float, cx: float, cy: float) -> str:
    return chain(name, source, [
        f"(u - {cx!r}::DOUBLE)/{fx!r}::DOUBLE AS px, (v - {cy!r}::DOUBLE)/{fy!r}::DOUBLE AS py",
        "sqrt(px*px + py*py + 1) AS pn",
        "(px*re + py*de + fe)/pn AS we, (px*rn + py*dn + fn)/pn AS wn, (px*ru + py*du + fu)/pn AS wu",
        "CASE WHEN abs(wu) >= 1e-9 AND -height/wu >= 0 THEN -height/wu END AS lam",
        "lam*we AS east, lam*wn AS north",
    ])


def direct(name: str, source: str, e: str = "east", n: str = "north", lat0: str = "cam_lat", lon0: str = "cam_lon") -> str:
    """Adds lat, lon: Vincenty's direct solution, three steps."""
    steps = [
        f"atan((1-{F!r}::DOUBLE)*tan(radians({lat0}))) AS u1, sqrt({e}*{e} + {n}*{n}) AS s",
        f"CASE WHEN s > 0 THEN {e}/s WHEN s = 0 THEN 0e0 END AS sa, CASE WHEN s > 0 THEN {n}/s WHEN s = 0 THEN 1e0 END AS ca",
        "cos(u1)*sa AS sal, atan2(sin(u1), cos(u1)*ca) AS s1",
        "1 - sal*sal AS c2",
        f"c2*{EP2!r}::DOUBLE AS u2",
        f"1 + u2/16384*(4096 + u2*(-768 + u2*(320 - 175*u2))) AS aa, u2/1024*(256 + u2*(-128 + u2*(74 - 47*u2))) AS bb",
        f"s/({B!r}::DOUBLE*aa) AS sg0",
    ]
    for k in range(3):
        steps.append(f"cos(2*s1 + sg{k}) AS cm{k}")
        steps.append(f"s/({B!r}::DOUBLE*aa) + bb*sin(sg{k})*(cm{k} + bb/4*(cos(sg{k})*(-1 + 2*cm{k}*cm{k}) - bb/6*cm{k}*(-3 + 4*sin(sg{k})*sin(sg{k}))*(-3 + 4*cm{k}*cm{k}))) AS sg{k + 1}")
    steps += [
        "sin(sg3) AS ss, cos(sg3) AS cs, cos(2*s1 + sg3) AS cm",
        f"atan2(ss*sa, cos(u1)*cs - sin(u1)*ss*ca) AS lm, {F!r}::DOUBLE/16*c2*(4 + {F!r}::DOUBLE*(4 - 3*c2)) AS cc",
        f"degrees(atan2(sin(u1)*cs + cos(u1)*ss*ca, (1-{F!r}::DOUBLE)*sqrt(sal*sal + (sin(u1)*ss - cos(u1)*cs*ca)*(sin(u1)*ss - cos(u1)*cs*ca)))) AS lat, {lon0} + degrees(lm - (1-cc)*{F!r}::DOUBLE*sal*(sg3 + cc*ss*(cm + cc*cs*(-1 + 2*cm*cm)))) AS lon",
    ]
    return chain(name, source, steps)


def inverse(name: str, source: str, lat: str, lon: str, lat0: str, lon0: str, e: str, n: str) -> str:
    """Adds east and north: Vincenty's inverse solution, four steps."""
    p = name
    steps = [f"atan((1-{F!r}::DOUBLE)*tan(radians({lat0}))) AS {p}a, atan((1-{F!r}::DOUBLE)*tan(radians({lat}))) AS {p}b, radians({lon} - ({lon0})) AS {p}l0"]
    steps.append(f"{p}l0 AS {p}k0")
    for k in range(5):
        steps.append(f"cos({p}b)*sin({p}k{k}) AS {p}x{k}, cos({p}a)*sin({p}b) - sin({p}a)*cos({p}b)*cos({p}k{k}) AS {p}y{k}, sin({p}a)*sin({p}b) + cos({p}a)*cos({p}b)*cos({p}k{k}) AS {p}cs{k}")
        steps.append(f"sqrt({p}x{k}*{p}x{k} + {p}y{k}*{p}y{k}) AS {p}ss{k}")
        steps.append(f"atan2({p}ss{k}, {p}cs{k}) AS {p}sg{k}, CASE WHEN {p}ss{k} > 0 THEN cos({p}a)*cos({p}b)*sin({p}k{k})/{p}ss{k} ELSE 0e0 END AS {p}sa{k}")
        steps.append(f"1 - {p}sa{k}*{p}sa{k} AS {p}ca{k}")
        steps.append(f"CASE WHEN {p}ca{k} > 1e-12 THEN {p}cs{k} - 2*sin({p}a)*sin({p}b)/{p}ca{k} ELSE 0e0 END AS {p}cm{k}, {F!r}::DOUBLE/16*{p}ca{k}*(4 + {F!r}::DOUBLE*(4 - 3*{p}ca{k})) AS {p}cc{k}")
        if k < 4:
            steps.append(f"{p}l0 + (1-{p}cc{k})*{F!r}::DOUBLE*{p}sa{k}*({p}sg{k} + {p}cc{k}*{p}ss{k}*({p}cm{k} + {p}cc{k}*{p}cs{k}*(-1 + 2*{p}cm{k}*{p}cm{k}))) AS {p}k{k + 1}")
    steps.append(f"{p}ca4*{EP2!r}::DOUBLE AS {p}u2")
    steps.append(f"1 + {p}u2/16384*(4096 + {p}u2*(-768 + {p}u2*(320 - 175*{p}u2))) AS {p}aa, {p}u2/1024*(256 + {p}u2*(-128 + {p}u2*(74 - 47*{p}u2))) AS {p}bb")
    steps.append(f"{B!r}::DOUBLE*{p}aa*({p}sg4 - {p}bb*{p}ss4*({p}cm4 + {p}bb/4*({p}cs4*(-1 + 2*{p}cm4*{p}cm4) - {p}bb/6*{p}cm4*(-3 + 4*{p}ss4*{p}ss4)*(-3 + 4*{p}cm4*{p}cm4)))) AS {p}d")
    steps.append(f"CASE WHEN {p}ss4 > 0 THEN {p}d*{p}x4/{p}ss4 WHEN {p}d IS NOT NULL THEN 0e0 END AS {e}, CASE WHEN {p}ss4 > 0 THEN {p}d*{p}y4/{p}ss4 WHEN {p}d IS NOT NULL THEN 0e0 END AS {n}")
    return chain(name, source, steps)
