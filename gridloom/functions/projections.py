"""Coordinate systems: well-known text to parameters, and projections as column expressions.

Geographic, Albers equal-area, Lambert conformal conic, (transverse) Mercator; ellipsoidal after
Snyder (1987) and Krueger's series to the fourth order (some 0.1 micrometres off within a zone).
Datums are not shifted: WGS 84 and NAD 83 count as one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of methods and parameters in well-known text, and ellipsoids.
METHODS = {
    "albers conic equal area": "albers",
    "albers": "albers",
    "albers equal area": "albers",
    "lambert conformal conic": "lambert",
    "lambert conformal conic 1sp": "lambert",
    "lambert conformal conic 2sp": "lambert",
    "lambert conic conformal 1sp": "lambert",
    "lambert conic conformal 2sp": "lambert",
    "transverse mercator": "transverse",
    "gauss kruger": "transverse",
    "mercator": "mercator",
    "mercator 1sp": "mercator",
    "mercator 2sp": "mercator",
    "mercator variant a": "mercator",
    "mercator variant b": "mercator",
    "mercator auxiliary sphere": "web",
    "popular visualisation pseudo mercator": "web",
}
PARAMETERS = {
    "latitude of origin": "lat0",
    "latitude of center": "lat0",
    "latitude of false origin": "lat0",
    "latitude of natural origin": "lat0",
    "central meridian": "lon0",
    "longitude of center": "lon0",
    "longitude of origin": "lon0",
    "longitude of false origin": "lon0",
    "longitude of natural origin": "lon0",
    "standard parallel 1": "lat1",
    "latitude of 1st standard parallel": "lat1",
    "standard parallel 2": "lat2",
    "latitude of 2nd standard parallel": "lat2",
    "scale factor": "k0",
    "scale factor at natural origin": "k0",
    "false easting": "x0",
    "easting at false origin": "x0",
    "false northing": "y0",
    "northing at false origin": "y0",
}
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)


@dataclass(frozen=True)
class System:
    """Angles in degrees; x0 and y0 in ``unit``s, which are metres (or degrees) each."""

    method: str = "geographic"
    axis: float = WGS84[0]
    flattening: float = 1 / WGS84[1]
    lat0: float = 0.0
    lon0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    k0: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


def nodes(text: str) -> list:
    """Well-known text as nested lists: name, then values and lists."""
    tokens = re.findall(r'"((?:[^"]|"")*)"|([A-Za-z_][\w]*)|([-+]?\d[\d.eE+-]*)|([\[\(\]\),])', text)
    stack: list[list] = [[]]
    for quoted, word, number, mark in tokens:
        if mark in "[(" and mark:
            inner = [stack[-1].pop()]
            stack[-1].append(inner)
            stack.append(inner)
        elif mark in "])" and mark:
            if len(stack) == 1:
                raise ValueError("unbalanced well-known text")
            stack.pop()
        elif number:
            stack[-1].append(float(number))
        elif not mark:
            stack[-1].append(word or quoted)
    if len(stack) != 1 or not stack[0] or not isinstance(stack[0][0], list):
        raise ValueError("not well-known text")
    return stack[0][0]


def _found(node: list, *names: str) -> list | None:
    """The first node with one of the names, inside ``node``."""
    for part in node[1:]:
        if isinstance(part, list):
            if str(part[0]).upper() in names:
                return part
            inner = _found(part, *names)
            if inner:
                return inner
    return None


def _plain(name: str) -> str:
    return " ".join(re.sub(r"[^0-9a-z]+", " ", name.lower()).split())


def _unit(node: list) -> float | None:
    """A node's own unit: metres or radians."""
    own = [p for p in node if isinstance(p, list) and str(p[0]).upper() in ("UNIT", "LENGTHUNIT", "ANGLEUNIT")]
    return own[-1][2] if own else None


def parse(text: str) -> System:
    """A system from well-known text (both versions); unknown methods and parameters raise."""
    root = nodes(text)
    if str(root[0]).upper() in ("COMPD_CS", "COMPOUNDCRS", "BOUNDCRS"):
        root = next(p for p in root[1:] if isinstance(p, list))
    ball = _found(root, "SPHEROID", "ELLIPSOID")
    if ball is None:
        raise ValueError("no ellipsoid in the well-known text")
    ellipsoid = {"axis": ball[2] * (_unit(ball) or 1.0), "flattening": 1 / ball[3] if ball[3] else 0.0}
    if str(root[0]).upper() in ("GEOGCS", "GEOGCRS", "GEODCRS"):
        return System(**ellipsoid)
    method = _found(root, "PROJECTION", "METHOD")
    kind = METHODS.get(_plain(str(method[1]))) if method else None
    if kind is None:
        raise ValueError(f"no projection for {method and method[1]}")
    angle = _unit(_found(root, "GEOGCS", "BASEGEOGCRS", "BASEGEODCRS") or []) or math.radians(1)
    unit = _unit(root) or 1.0
    given: dict[str, float] = {}
    for part in [*root[1:], *(_found(root, "CONVERSION") or [])]:
        if isinstance(part, list) and str(part[0]).upper() == "PARAMETER":
            name = PARAMETERS.get(_plain(part[1]))
            if name is None:
                if part[2]:
                    raise ValueError(f"no use for parameter {part[1]}")
                continue
            own = _unit(part)
            if name in ("x0", "y0"):
                given[name] = part[2] * (own / unit if own else 1.0)
            elif name == "k0":
                given[name] = part[2]
            else:
                by = math.degrees(own or angle)
                given[name] = part[2] * (1.0 if abs(by - 1) < 1e-12 else by)  # degrees, written with fewer digits
    return System(kind, unit=unit, **ellipsoid, **given)


def system(code: int | str | System) -> System:
    """A system by number (EPSG or ESRI, those below), as well-known text, or as it is."""
    if isinstance(code, System):
        return code
    if isinstance(code, str) and not re.match(r"(?:(?:EPSG|ESRI):)?\d+$", code):
        return parse(code)
    number = int(str(code).split(":")[-1])
    nad83 = System(axis=GRS80[0], flattening=1 / GRS80[1])
    zone = number % 100
    if number == 4326:
        return System()
    if number == 4269:
        return nad83
    if number == 3857:
        return System("web")
    if 1 <= zone <= 60 and number // 100 in (326, 327):
        return System("transverse", lon0=6.0 * zone - 183, k0=0.9996, x0=500_000.0, y0=10_000_000.0 if number // 100 == 327 else 0.0)
    if 1 <= zone <= 23 and number // 100 == 269:
        return replace(nad83, method="transverse", lon0=6.0 * zone - 183, k0=0.9996, x0=500_000.0)
    conic = {102003: ("albers", 37.5, 29.5, 45.5), 5070: ("albers", 23.0, 29.5, 45.5), 102004: ("lambert", 39.0, 33.0, 45.0)}
    if number in conic:
        method, lat0, lat1, lat2 = conic[number]
        return replace(nad83, method=method, lat0=lat0, lon0=-96.0, lat1=lat1, lat2=lat2)
    raise ValueError(f"no system {code}")


def _isometric(s: System, phi: float) -> float:
    return math.atanh(math.sin(phi)) - s.e * math.atanh(s.e * math.sin(phi))


def _m(s: System, phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - s.e2 * math.sin(phi) ** 2)


def _q(s: System, phi: float) -> float:
    sin = math.sin(phi)
    if not s.e:
        return 2 * sin
    return (1 - s.e2) * (sin / (1 - s.e2 * sin**2) + math.atanh(s.e * sin) / s.e)


def _series(s: System) -> tuple[float, float, list[float], list[float]]:
    """The rectifying radius, the northing of lat0, and Krueger's coefficients both ways."""
    n = s.flattening / (2 - s.flattening)
    radius = s.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    xi = math.atan(math.sinh(_isometric(s, math.radians(s.lat0))))
    return radius, xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(there)), there, back


def _cone(s: System) -> tuple[float, float, float]:
    """Of a conic projection: the cone's constant, its scale, the radius of lat0 (in axes)."""
    p0, p1 = math.radians(s.lat0), math.radians(s.lat0 if s.lat1 is None else s.lat1)
    p2 = p1 if s.lat2 is None else math.radians(s.lat2)
    if s.method == "albers":
        n = math.sin(p1) if p1 == p2 else (_m(s, p1) ** 2 - _m(s, p2) ** 2) / (_q(s, p2) - _q(s, p1))
        c = _m(s, p1) ** 2 + n * _q(s, p1)
        return n, c, math.sqrt(c - n * _q(s, p0)) / n
    n = math.sin(p1) if p1 == p2 else (math.log(_m(s, p1)) - math.log(_m(s, p2))) / (_isometric(s, p2) - _isometric(s, p1))
    c = s.k0 * _m(s, p1) / n * math.exp(n * _isometric(s, p1))
    return n, c, c * math.exp(-n * _isometric(s, p0))


def _mercator(s: System) -> float:
    return s.axis * (s.k0 if s.lat1 is None else _m(s, math.radians(s.lat1)))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def project(to: int | str | System, lon: Column, lat: Column) -> Column:
    """Longitude and latitude in degrees to a point of a system."""
    s = system(to)
    if s.method == "geographic":
        return _point(lon.cast("double"), lat.cast("double"))
    turned = F.radians((lon - s.lon0) - 360 * F.floor((lon - s.lon0 + 180) / 360))
    sin = F.sin(F.radians(lat))
    psi = F.atanh(sin) - s.e * F.atanh(s.e * sin)
    if s.method == "web":
        x, y = s.axis * turned, s.axis * F.atanh(sin)
    elif s.method == "mercator":
        x, y = _mercator(s) * turned, _mercator(s) * psi
    elif s.method == "transverse":
        radius, start, there, _ = _series(s)
        tau = F.sinh(psi)
        xi = F.atan2(tau, F.cos(turned))
        eta = F.asinh(F.sin(turned) / F.sqrt(tau * tau + F.cos(turned) * F.cos(turned)))
        north = xi + sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(there)), F.lit(0.0))
        east = eta + sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(there)), F.lit(0.0))
        x, y = s.k0 * radius * east, s.k0 * radius * (north - start)
    else:
        n, c, rho0 = _cone(s)
        if s.method == "albers":
            q = (1 - s.e2) * (sin / (1 - s.e2 * sin * sin) + F.atanh(s.e * sin) / s.e) if s.e else 2 * sin
            rho = F.sqrt(c - n * q) / n
        else:
            rho = c * F.exp(-n * psi)
        x, y = s.axis * rho * F.sin(n * turned), s.axis * (rho0 - rho * F.cos(n * turned))
    return _point(x / s.unit + s.x0, y / s.unit + s.y0)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _from_isometric(s: System, psi: Column) -> Column:
    """The latitude: Snyder's series in the conformal latitude to e^8, then a step of the exact fixed point."""
    e2 = s.e2
    if not e2:
        return F.atan(F.sinh(psi))
    terms = [e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280]
    phi = lambda chi: chi + sum((c * F.sin(2 * (j + 1) * chi) for j, c in enumerate(terms)), F.lit(0.0))
    return let(psi, lambda k: F.atan(F.sinh(k + s.e * F.atanh(s.e * F.sin(let(F.atan(F.sinh(k)), phi))))))


def _from_authalic(s: System, q: Column) -> Column:
    """The latitude: Snyder's series in the authalic latitude to e^6, then a step of Newton's."""
    beta, e2 = (lambda v: F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / _q(s, math.pi / 2))))), s.e2
    if not e2:
        return beta(q)
    terms = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]

    def newton(v: Column, phi: Column) -> Column:
        def step(sin: Column) -> Column:
            w = 1 - e2 * sin * sin
            return phi + w * w / (2 * F.cos(phi)) * (v / (1 - e2) - sin / w - F.atanh(s.e * sin) / s.e)

        return let(F.sin(phi), step)

    series = lambda b: b + sum((c * F.sin(2 * (j + 1) * b) for j, c in enumerate(terms)), F.lit(0.0))
    return let(q, lambda v: let(let(beta(v), series), lambda phi: newton(v, phi)))


def unproject(of: int | str | System, x: Column, y: Column) -> Column:
    """A point of a system to longitude and latitude in degrees."""
    s = system(of)
    if s.method == "geographic":
        return _point(x.cast("double"), y.cast("double"))
    east, north = (x - s.x0) * s.unit, (y - s.y0) * s.unit
    if s.method == "web":
        turned, lat = east / s.axis, F.atan(F.sinh(north / s.axis))
    elif s.method == "mercator":
        turned, lat = east / _mercator(s), _from_isometric(s, north / _mercator(s))
    elif s.method == "transverse":
        radius, first, _, back = _series(s)
        xi, eta = north / (s.k0 * radius) + first, east / (s.k0 * radius)

        def sphere(p: Column) -> Column:
            xi1 = p["x"] - sum((c * F.sin(2 * (j + 1) * p["x"]) * F.cosh(2 * (j + 1) * p["y"]) for j, c in enumerate(back)), F.lit(0.0))
            eta1 = p["y"] - sum((c * F.cos(2 * (j + 1) * p["x"]) * F.sinh(2 * (j + 1) * p["y"]) for j, c in enumerate(back)), F.lit(0.0))
            return let(_point(xi1, eta1), lambda z: _point(F.atan2(F.sinh(z["y"]), F.cos(z["x"])), F.asinh(F.sin(z["x"]) / F.sqrt(F.sinh(z["y"]) * F.sinh(z["y"]) + F.cos(z["x"]) * F.cos(z["x"])))))

        around = let(_point(xi, eta), sphere)
        turned, lat = around["x"], _from_isometric(s, around["y"])
    else:
        n, c, rho0 = _cone(s)
        dx, dy = math.copysign(1.0, n) * east / s.axis, math.copysign(1.0, n) * (rho0 - north / s.axis)
        turned = F.atan2(dx, dy) / n
        if s.method == "albers":
            lat = _from_authalic(s, (c - (dx * dx + dy * dy) * (n * n)) / n)
        else:
            lat = _from_isometric(s, F.ln(abs(c) / F.sqrt(dx * dx + dy * dy)) / n)
    lon = let(F.degrees(turned) + s.lon0, lambda v: v - 360 * F.floor((v + 180) / 360))
    return _point(lon, F.degrees(lat))


def between(source: int | str | System, target: int | str | System, x: Column, y: Column) -> Column:
    """A point of one system in another."""
    a, b = system(source), system(target)
    if a == b:
        return _point(x, y)
    return let(unproject(a, x, y), lambda p: project(b, p["x"], p["y"]))
