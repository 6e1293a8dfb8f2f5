"""Geometry on arrays of points: rings are array<struct<x, y>>, closed (first = last)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import nesting, projections


def point(x, y) -> Column:
    """A point of two columns or numbers."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def box_ring(x0, y0, x1, y1) -> Column:
    """The closed ring of a rectangle."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def bounds(ring: Column) -> Column:
    """(minx, miny, maxx, maxy) of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def ring_edges(ring: Column) -> Column:
    """(a, b) of each side."""
    n = F.size(ring)
    tail = F.slice(ring, 2, F.greatest(n - 1, F.lit(0)))
    head = F.slice(ring, 1, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def area(ring: Column) -> Column:
    """Shoelace area; NULL for a NULL ring."""
    twice = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2


def clip_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a ring inside a rectangle, as one ring; empty if there is none.

    Sutherland-Hodgman: a fold over the four half-planes, so the expression stays small.
    """
    planes = F.array(
        *[F.struct(F.lit(on_x).alias("on_x"), at.cast("double").alias("at"), F.lit(sign).alias("sign")) for on_x, at, sign in ((True, x0, 1.0), (True, x1, -1.0), (False, y0, 1.0), (False, y1, -1.0))]
    )

    def clip(r: Column, h: Column) -> Column:
        depth = lambda p: h["sign"] * (F.when(h["on_x"], p["x"]).otherwise(p["y"]) - h["at"])

        def crossing(a: Column, b: Column) -> Column:
            t = F.try_divide(depth(a), depth(a) - depth(b))
            x = F.when(h["on_x"], h["at"]).otherwise(a["x"] + t * (b["x"] - a["x"]))
            y = F.when(h["on_x"], a["y"] + t * (b["y"] - a["y"])).otherwise(h["at"])
            return F.struct(x.alias("x"), y.alias("y"))

        def side(e: Column) -> Column:
            a, b = e["a"], e["b"]
            now, then = depth(a) >= 0, depth(b) >= 0
            return F.when(now & then, F.array(b)).when(now, F.array(crossing(a, b))).when(then, F.array(crossing(a, b), b)).otherwise(F.slice(F.array(b), 1, 0))

        out = F.flatten(F.transform(ring_edges(r), side))
        closed = F.transform(F.array(out), lambda o: F.when(F.size(o) > 0, F.concat(F.slice(o, -1, 1), o)).otherwise(o))
        return F.element_at(closed, 1)

    return F.aggregate(planes, ring, clip)


def area_in_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a simple ring's part inside a rectangle, without building that part.

    Each side adds the signed area between itself, held to y0..y1, and y0 over its share of
    x0..x1: one pass over the sides.
    """

    def under(e: Column) -> Column:
        a, b = e["a"], e["b"]
        left, right = F.greatest(F.least(a["x"], b["x"]), x0), F.least(F.greatest(a["x"], b["x"]), x1)
        width, slope = right - left, F.try_divide(b["y"] - a["y"], b["x"] - a["x"])

        def above(floor: Column) -> Column:
            u, v = a["y"] + slope * (left - a["x"]) - floor, a["y"] + slope * (right - a["x"]) - floor
            tip = F.greatest(u, v)
            return F.when((u >= 0) & (v >= 0), width * (u + v) / 2).when(tip <= 0, 0.0).otherwise(tip * tip / (2 * F.abs(slope)))

        part = above(y0) - above(y1)
        return F.when(width <= 0, 0.0).when(a["x"] < b["x"], part).otherwise(-part)

    return F.abs(F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + under(e)))


def box_overlap_area(a: Column, b: Column) -> Column:
    """Common area of two bounds."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Strict: touching is no overlap."""
    return (a["minx"] < b["maxx"]) & (b["minx"] < a["maxx"]) & (a["miny"] < b["maxy"]) & (b["miny"] < a["maxy"])


def boxes_touch(a: Column, b: Column) -> Column:
    """Overlap, or touch."""
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring (crossings of a ray; lower and left sides belong to it)."""
    return _sides_contain(ring_edges(ring), x, y)


def _sides_contain(edges: Column, x: Column, y: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] <= y) != (b["y"] <= y)
        at = a["x"] + F.try_divide(y - a["y"], b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _on(a: Column, b: Column, c: Column) -> Column:
    within = lambda k: (c[k] >= F.least(a[k], b[k])) & (c[k] <= F.greatest(a[k], b[k]))
    return (_turn(a, b, c) == 0) & within("x") & within("y")


def sides_meet(e: Column, f: Column) -> Column:
    """Whether two sides share a point."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    cross = (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)
    return cross | _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)


def near_sides(edges: Column, box: Column) -> Column:
    """Sides whose own bounds touch ``box``: one pass, so that only these are compared in pairs."""
    low, high = (lambda e, k: F.least(e["a"][k], e["b"][k])), (lambda e, k: F.greatest(e["a"][k], e["b"][k]))
    return F.filter(edges, lambda e: (low(e, "x") <= box["maxx"]) & (high(e, "x") >= box["minx"]) & (low(e, "y") <= box["maxy"]) & (high(e, "y") >= box["miny"]))


def intersects(a: Column, b: Column) -> Column:
    """Whether two rings share a point: sides meet, or one holds the other."""
    near = F.transform(F.array(bounds(a)), lambda box: near_sides(ring_edges(b), box))[0]
    meet = F.exists(ring_edges(a), lambda e: F.exists(near, lambda f: sides_meet(e, f)))
    return meet | contains(a, _first(b)["x"], _first(b)["y"]) | contains(b, _first(a)["x"], _first(a)["y"])


def sides_meet_box(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an area, given by the sides of its rings, shares a point with a rectangle.

    A side does unless their bounds are apart or the rectangle lies on one side of its line; else
    the area holds the rectangle whole or not at all.  One pass, no pairs of sides.
    """

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        over = lambda k, low, high: (F.least(a[k], b[k]) <= high) & (F.greatest(a[k], b[k]) >= low)
        u = [(b["x"] - a["x"]) * (y - a["y"]) for y in (y0, y1)]
        v = [(b["y"] - a["y"]) * (x - a["x"]) for x in (x0, x1)]
        return over("x", x0, x1) & over("y", y0, y1) & (F.least(*u) <= F.greatest(*v)) & (F.greatest(*u) >= F.least(*v))

    return F.exists(edges, meets) | _sides_contain(edges, x0, y0)


def _first(ring: Column) -> Column:
    return F.try_element_at(ring, F.lit(1))


# Polygons of several rings (array of rings): holes, islands in them and separate parts, in any
# order and direction.  A point is inside if an odd number of rings holds it.


def rings_bounds(rings: Column) -> Column:
    """(minx, miny, maxx, maxy) of all rings."""
    return bounds(F.flatten(rings))


def rings_edges(rings: Column) -> Column:
    """(a, b) of each side of each ring."""
    return F.flatten(F.transform(rings, ring_edges))


def rings_contain(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a polygon of several rings."""
    return F.aggregate(rings, F.lit(0), lambda s, r: s + F.when(contains(r, x, y), 1).otherwise(0)) % 2 == 1


def rings_intersect(ring: Column, rings: Column) -> Column:
    """Whether a ring's area and a polygon of several rings share a point."""
    near = F.transform(F.array(bounds(ring)), lambda box: near_sides(rings_edges(rings), box))[0]
    meet = F.exists(ring_edges(ring), lambda e: F.exists(near, lambda f: sides_meet(e, f)))
    held = F.exists(rings, lambda r: contains(ring, _first(r)["x"], _first(r)["y"]))
    return meet | held | rings_contain(rings, _first(ring)["x"], _first(ring)["y"])


def _signs(rings: Column) -> Column:
    """1 for rings that add area, -1 for holes: once a polygon, in batches of them (``nesting.signs``)."""
    return F.arrow_udf(lambda v: nesting.signs(v), "array<double>")(rings)


def rings_area(rings: Column) -> Column:
    """Area of a polygon of several rings that do not cross."""
    return F.aggregate(F.zip_with(rings, _signs(rings), lambda r, s: area(r) * s), F.lit(0.0), lambda t, a: t + a)


def rings_area_in_box(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of its part inside a rectangle."""
    return F.aggregate(F.zip_with(rings, _signs(rings), lambda r, s: area_in_box(r, x0, y0, x1, y1) * s), F.lit(0.0), lambda t, a: t + a)


def pixel_bounds(row: Column, col: Column, t: dict[str, float]) -> Column:
    """Bounds of a pixel under an affine transform (a..f)."""
    xs = [F.lit(t["c"]) + (col + d) * F.lit(t["a"]) for d in (0, 1)]
    ys = [F.lit(t["f"]) + (row + d) * F.lit(t["e"]) for d in (0, 1)]
    return F.struct(F.least(*xs).alias("minx"), F.least(*ys).alias("miny"), F.greatest(*xs).alias("maxx"), F.greatest(*ys).alias("maxy"))


def window_transform(t: dict[str, float], row0: int, col0: int) -> dict[str, float]:
    """The transform of a window that starts at (row0, col0)."""
    return {**t, "c": t["c"] + col0 * t["a"] + row0 * t["b"], "f": t["f"] + col0 * t["d"] + row0 * t["e"]}


def window_bounds(t: dict[str, float], row0: int, col0: int, height: int, width: int) -> tuple[float, float, float, float]:
    """(left, bottom, right, top) of a window."""
    own = window_transform(t, row0, col0)
    x1, y1 = own["c"] + width * t["a"], own["f"] + height * t["e"]
    return min(own["c"], x1), min(own["f"], y1), max(own["c"], x1), max(own["f"], y1)


def bounds_window(t: dict[str, float], left: float, bottom: float, right: float, top: float) -> tuple[int, int, int, int]:
    """(row0, col0, height, width) of the window that bounds cover, to whole pixels."""
    c0, c1 = sorted(((left - t["c"]) / t["a"], (right - t["c"]) / t["a"]))
    r0, r1 = sorted(((top - t["f"]) / t["e"], (bottom - t["f"]) / t["e"]))
    row0, col0 = math.floor(r0 + 1e-9), math.floor(c0 + 1e-9)
    return row0, col0, math.ceil(r1 - 1e-9) - row0, math.ceil(c1 - 1e-9) - col0


# The conterminous US Albers equal-area projection (ESRI:102003) on GRS80.
_A, _F = 6378137.0, 1 / 298.257222101
_LON0, _LAT0, _LAT1, _LAT2 = -96.0, 37.5, 29.5, 45.5
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(sin_phi: float) -> float:
    return (1 - _E2) * (sin_phi / (1 - _E2 * sin_phi**2) - math.log((1 - _E * sin_phi) / (1 + _E * sin_phi)) / (2 * _E))


def _m2(phi: float) -> float:
    return math.cos(phi) ** 2 / (1 - _E2 * math.sin(phi) ** 2)


_P1, _P2, _P0 = (math.radians(v) for v in (_LAT1, _LAT2, _LAT0))
_N = (_m2(_P1) - _m2(_P2)) / (_q(math.sin(_P2)) - _q(math.sin(_P1)))
_C = _m2(_P1) + _N * _q(math.sin(_P1))
_RHO0 = _A * math.sqrt(_C - _N * _q(math.sin(_P0))) / _N


def albers(lon: Column, lat: Column) -> Column:
    """Longitude and latitude (degrees) to metres (Snyder 1987, ellipsoidal)."""
    s = F.sin(F.radians(lat))
    q = F.lit(1 - _E2) * (s / (1 - F.lit(_E2) * s * s) - F.ln((1 - F.lit(_E) * s) / (1 + F.lit(_E) * s)) / F.lit(2 * _E))
    rho = F.lit(_A) * F.sqrt(F.lit(_C) - F.lit(_N) * q) / F.lit(_N)
    theta = F.lit(_N) * F.radians(lon - F.lit(_LON0))
    return F.struct((rho * F.sin(theta)).alias("x"), (F.lit(_RHO0) - rho * F.cos(theta)).alias("y"))


def albers_inverse(x: Column, y: Column, rounds: int = 6) -> Column:
    """Metres to longitude and latitude in degrees."""
    dy = F.lit(_RHO0) - y
    rho = F.sqrt(x * x + dy * dy)
    q = (F.lit(_C) - F.pow(rho * F.lit(_N / _A), 2)) / F.lit(_N)

    def step(phi: Column, _: Column) -> Column:
        s = F.sin(phi)
        w = 1 - F.lit(_E2) * s * s
        return phi + w * w / (2 * F.cos(phi)) * (q / F.lit(1 - _E2) - s / w + F.ln((1 - F.lit(_E) * s) / (1 + F.lit(_E) * s)) / F.lit(2 * _E))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.asin(q / 2), step)
    return F.struct((F.lit(_LON0) + F.degrees(F.atan2(x, dy)) / F.lit(_N)).alias("x"), F.degrees(phi).alias("y"))


def reproject(ring: Column, source: int | str, target: int | str) -> Column:
    """A ring in another system: numbers or well-known text that ``projections.system`` takes."""
    if source == target:
        return ring
    if (source, target) == (4326, 102003):
        return F.transform(ring, lambda p: albers(p["x"], p["y"]))
    if (source, target) == (102003, 4326):
        return F.transform(ring, lambda p: albers_inverse(p["x"], p["y"]))
    return F.transform(ring, lambda p: projections.between(source, target, p["x"], p["y"]))
