"""Which rings of a polygon are holes, for many polygons at a time (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .noding import runs


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)


def _lowest(ring: np.ndarray, values: np.ndarray, rings: int) -> np.ndarray:
    out = np.full(rings, np.inf)
    np.minimum.at(out, ring, values)
    return out


def signs(polygons: pa.Array) -> pa.Array:
    """1.0 for rings that add area, -1.0 for holes: by the number of larger rings around a point inside.

    Rings may touch and share sides; of equal rings, the first is around the others.
    """
    held = _lengths(polygons)
    rings = polygons.flatten()
    sizes, points = _lengths(rings), rings.flatten()
    x, y = (pc.struct_field(points, k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(2))
    n, ends = len(sizes), np.cumsum(sizes)
    last = np.zeros(len(x), bool)
    last[ends[sizes > 0] - 1] = True
    a = np.flatnonzero(~last)
    ring = np.repeat(np.arange(n), sizes)
    own = ring[a]
    xa, ya, xb, yb = x[a], y[a], x[a + 1], y[a + 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        area = np.abs(np.bincount(own, xa * yb - xb * ya, n)) / 2
        # A point inside: in the middle of the lowest two crossings of a line between the lowest two heights.
        low = _lowest(ring, y, n)
        above = y > low[ring]
        mid = (low + _lowest(ring[above], y[above], n)) / 2
        spans = (ya <= mid[own]) != (yb <= mid[own])
        at = (xa + (mid[own] - ya) / (yb - ya) * (xb - xa))[spans]
        crossed = own[spans]
        order = np.lexsort([at, crossed])
        at, crossed = at[order], crossed[order]
        start = np.searchsorted(crossed, np.arange(n))
        two = np.bincount(crossed, minlength=n) > 1
        px = np.full(n, np.nan)
        px[two] = (at[start[two]] + at[start[two] + 1]) / 2
        least, most = (_lowest(ring, y, n), -_lowest(ring, -y, n)), (_lowest(ring, x, n), -_lowest(ring, -x, n))
        around = np.zeros(n, int)
        first = np.repeat(np.cumsum(held) - held, held)
        side, sides = np.searchsorted(own, np.arange(n)), np.bincount(own, minlength=n)
        for k, o in runs(np.repeat(held, held)):
            o = first[k] + o
            larger = (area[o] > area[k]) | ((area[o] == area[k]) & (o < k))
            near = larger & (mid[k] >= least[0][o]) & (mid[k] <= least[1][o]) & (px[k] >= most[0][o]) & (px[k] <= most[1][o])
            k, o = k[near], o[near]
            for pair, e in runs(sides[o]):
                e = side[o[pair]] + e
                u, v = px[k[pair]], mid[k[pair]]
                cuts = ((ya[e] <= v) != (yb[e] <= v)) & (u < xa[e] + (v - ya[e]) / (yb[e] - ya[e]) * (xb[e] - xa[e]))
                pairs, times = np.unique(pair[cuts], return_counts=True)
                np.add.at(around, k[pairs[times % 2 == 1]], 1)
    out = pa.array(np.where(around % 2 == 1, -1.0, 1.0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32), mask=np.concatenate([polygons.is_null().to_numpy(zero_copy_only=False), [False]])), out)
