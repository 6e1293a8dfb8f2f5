"""Repair of rings that cross or touch themselves, for many polygons at a time (numpy).

Sides are cut wherever they meet (a sweep over their extents finds who may meet whom).  Crossing
a piece that was walked an odd number of times changes between inside and outside, so these
pieces are the border of all faces of odd winding.  They are turned so that the inside lies on
the left and chained into rings; where a chain comes back to a point, a ring is split off.
"""

from __future__ import annotations

import numpy as np

Rings = list[np.ndarray]
#: Of the polygon's extent: points nearer than this are one.
SNAP = 1e-11
#: Pairs of sides looked at together.
PAIRS = 1 << 20


def _sides(points: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polygon of each side that is no point, of rings of so many points; open rings are closed."""
    ends = np.cumsum(sizes)
    follow = np.arange(1, len(points) + 1)
    follow[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    end = points[follow]
    real = (points != end).any(1)
    return points[real], end[real], np.repeat(owner, sizes)[real]


def runs(many: np.ndarray):
    """Spans of items that have some PAIRS pairs together, so many each, and the item and number of each pair."""
    at = np.concatenate([[0], np.cumsum(many)])
    i, n = 0, len(many)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PAIRS, side="right")) - 1)
        one = np.repeat(np.arange(i, j), many[i:j])
        yield one, np.arange(len(one)) - np.repeat(at[i:j] - at[i], many[i:j])
        i = j


def _pairs(low: np.ndarray, high: np.ndarray, g: np.ndarray):
    """Pairs i < j of sides of one polygon, in order of polygons and left ends, whose bounds touch."""
    n = len(low)
    order = np.lexsort([np.repeat([0, 1], n), np.concatenate([low[:, 0], high[:, 0]]), np.concatenate([g, g])])
    last = np.empty(2 * n, int)
    last[order] = np.cumsum(order < n)  # left ends up to each end
    for one, k in runs(np.maximum(last[n:] - np.arange(n) - 1, 0)):
        two = one + 1 + k
        near = (low[one, 1] <= high[two, 1]) & (low[two, 1] <= high[one, 1])
        yield one[near], two[near]


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]


def _meetings(a: np.ndarray, b: np.ndarray, g: np.ndarray, tols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(side, point): where sides meet others of their polygon, their own ends left out."""
    low, high = np.minimum(a, b) - tols[g, None], np.maximum(a, b) + tols[g, None]
    order = np.lexsort([low[:, 0], g])
    sides, points = [np.zeros(0, int)], [np.zeros((0, 2))]
    for i, j in _pairs(low[order], high[order], g[order]):
        i, j = order[i], order[j]
        tol = tols[g[i]]
        # Ends of one on the other: also where both lie on one line.
        for p, q in ((i, j), (j, i)):
            d = b[p] - a[p]
            length = np.hypot(d[:, 0], d[:, 1])
            for end in (a[q], b[q]):
                away = np.abs(_cross(d, end - a[p])) / length
                along = ((end - a[p]) * d).sum(1) / length
                on = (away <= tol) & (along > tol) & (along < length - tol)
                sides.append(p[on])
                points.append(end[on])
        r, s = b[i] - a[i], b[j] - a[j]
        lr, ls = np.hypot(r[:, 0], r[:, 1]), np.hypot(s[:, 0], s[:, 1])
        # A crossing: the ends of each clearly on both sides of the other.
        d1, d2 = _cross(r, a[j] - a[i]) / lr, _cross(r, b[j] - a[i]) / lr
        d3, d4 = _cross(s, a[i] - a[j]) / ls, _cross(s, b[i] - a[j]) / ls
        clear = np.minimum(np.minimum(np.abs(d1), np.abs(d2)), np.minimum(np.abs(d3), np.abs(d4))) > tol
        proper = clear & (np.sign(d1) != np.sign(d2)) & (np.sign(d3) != np.sign(d4))
        t = d3[proper] / (d3[proper] - d4[proper])
        at = a[i[proper]] + t[:, None] * r[proper]
        sides += [i[proper], j[proper]]
        points += [at, at]
    return np.concatenate(sides), np.concatenate(points)


def _named(points: np.ndarray, g: np.ndarray, tols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each point, and the points by number: those of a polygon within its tolerance along x, then y, chain into one."""
    def ranks(v: np.ndarray) -> np.ndarray:
        order = np.lexsort([v, g])
        out = np.empty(len(v), int)
        other = (np.diff(v[order]) > tols[g[order[1:]]]) | (np.diff(g[order]) > 0)
        out[order] = np.concatenate([[0], np.cumsum(other)])
        return out

    x, y = ranks(points[:, 0]), ranks(points[:, 1])
    _, first, name = np.unique(x * (int(y.max()) + 1) + y, return_index=True, return_inverse=True)
    return name.reshape(-1), points[first]


def _inside_above(a: np.ndarray, b: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the inside lies above each piece (left of an upright one), by the parity of its polygon's pieces above its middle."""
    flat = np.abs(b[:, 0] - a[:, 0]) >= np.abs(b[:, 1] - a[:, 1])
    out = np.zeros(len(a), bool)
    first, past = np.searchsorted(g, g), np.searchsorted(g, g, side="right")
    for turned in (False, True):
        which = np.flatnonzero(flat != turned)
        p, q = (a[:, ::-1], b[:, ::-1]) if turned else (a, b)
        left, right = np.where(p[:, :1] <= q[:, :1], p, q), np.where(p[:, :1] <= q[:, :1], q, p)
        mid = (p + q) / 2
        for one, k in runs((past - first)[which]):
            i = which[one]
            j = first[i] + k
            met = (left[j, 0] <= mid[i, 0]) & (right[j, 0] > mid[i, 0]) & (i != j)
            i, j = i[met], j[met]
            t = (mid[i, 0] - left[j, 0]) / (right[j, 0] - left[j, 0])
            over = left[j, 1] + t * (right[j, 1] - left[j, 1]) > mid[i, 1]
            own, n = np.unique(i[over], return_counts=True)
            out[own] = n % 2 == 1
    return out


def _chained(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> list[list[int]]:
    """Simple rings (numbers of points) of directed pieces, the inside on their left."""
    d = points[b] - points[a]
    angle = np.arctan2(d[:, 1], d[:, 0]).tolist()
    back = np.arctan2(-d[:, 1], -d[:, 0]).tolist()
    a, b = a.tolist(), b.tolist()
    leaving: dict[int, list[int]] = {}
    for e, v in enumerate(a):
        leaving.setdefault(v, []).append(e)
    used = [False] * len(a)
    rings = []
    for first in range(len(a)):
        if used[first]:
            continue
        e, path, at = first, [], {}
        while not used[e]:
            used[e] = True
            v = a[e]
            if v in at:  # a ring is closed: split it off
                start = at[v]
                rings.append(path[start:])
                for w in path[start:]:
                    del at[w]
                del path[start:]
            at[v] = len(path)
            path.append(v)
            free = [f for f in leaving.get(b[e], ()) if not used[f]]
            if not free:
                break
            # The first to the right of the way back: the same face goes on there.
            e = free[0] if len(free) == 1 else min(free, key=lambda f: (back[e] - angle[f]) % (2 * np.pi) or 2 * np.pi)
        rings.append(path)
    return [r for r in rings if len(r) > 2]


def even_odd(rings: Rings) -> Rings:
    """Simple closed rings around what lies in an odd number of windings: outer rings counterclockwise, holes clockwise.

    No ring, points and lines without area give no rings.
    """
    points = np.concatenate(rings) if rings else np.zeros((0, 2))
    made, sizes, _ = even_odd_of_many(points, np.array([len(r) for r in rings], int), np.zeros(len(rings), int))
    return np.split(made, np.cumsum(sizes)[:-1]) if len(sizes) else []


def even_odd_of_many(points: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``even_odd`` of many polygons at once: points, sizes and polygons of the rings made from those of the rings given.

    Polygons are numbers that do not descend from ring to ring.
    """
    none = np.zeros((0, 2)), np.zeros(0, int), np.zeros(0, int)
    a, b, g = _sides(points, sizes, owner)
    if not len(a):
        return none
    polygons, starts, g = np.unique(g, return_index=True, return_inverse=True)
    low, high = np.minimum.reduceat(np.minimum(a, b), starts), np.maximum.reduceat(np.maximum(a, b), starts)
    origin = (low + high) / 2
    a, b = a - origin[g], b - origin[g]
    tols = SNAP * np.maximum.reduceat(np.maximum(np.abs(a), np.abs(b)).max(1), starts)
    side, met = _meetings(a, b, g, tols)
    n = len(a)
    own = np.concatenate([np.arange(n), np.arange(n), side])
    name, points = _named(np.concatenate([a, b, met]), g[own], tols)
    polygon = np.empty(len(points), int)
    polygon[name] = g[own]
    d = b - a
    along = ((points[name] - a[own]) * d[own]).sum(1)
    along[:n], along[n : 2 * n] = -np.inf, np.inf
    order = np.lexsort([along, own])
    own, name = own[order], name[order]
    piece = (own[1:] == own[:-1]) & (name[1:] != name[:-1])
    u, v = name[:-1][piece], name[1:][piece]
    pairs, times = np.unique(np.minimum(u, v) * len(points) + np.maximum(u, v), return_counts=True)
    u, v = np.divmod(pairs[times % 2 == 1], len(points))
    if not len(u):
        return none
    p, q = points[u], points[v]
    flat = np.abs(q[:, 0] - p[:, 0]) >= np.abs(q[:, 1] - p[:, 1])
    # Left of a piece is above it if it goes to the right; of an upright one, "above" is at its right.
    forward = np.where(flat, q[:, 0] > p[:, 0], q[:, 1] < p[:, 1])
    turn = _inside_above(p, q, polygon[u]) != forward
    made = _chained(np.where(turn, v, u), np.where(turn, u, v), points)
    if not made:
        return none
    at = np.array([w for r in made for w in (*r, r[0])], int)
    of = polygon[[r[0] for r in made]]
    return points[at] + origin[polygon[at]], np.array([len(r) + 1 for r in made], int), polygons[of]


def signed_area(ring: np.ndarray) -> float:
    """Positive if counterclockwise."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)
