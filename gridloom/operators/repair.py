"""Valid polygons from rings that cross or touch themselves: one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.noding import even_odd_of_many

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(_POINT))


#: Points of the polygons repaired together, unless one has more.
POINTS = 1 << 16


def _lists(points: np.ndarray, sizes: np.ndarray, many: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Arrow's lists (``many`` in each, NULL where ``missing``) of lists (so many ``sizes``) of points."""
    made = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), made)
    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.concatenate([missing, [False]])), rings)


def _many(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)


def _repaired(column: pa.Array, several: bool) -> pa.Array:
    rows = np.arange(len(column))
    owner = np.repeat(rows, _many(column)) if several else rows
    rings = column.flatten() if several else column
    sizes, points = _many(rings), rings.flatten()
    xy = np.stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(2)], 1)
    whole = np.isfinite(xy).all(1)
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[whole], minlength=len(sizes))
    xy, ends = xy[whole], np.concatenate([[0], np.cumsum(sizes)])
    # Runs of whole polygons.
    first, past = np.searchsorted(owner, rows), np.searchsorted(owner, rows, side="right")
    made, r = [], 0
    while r < len(rows):
        to = max(r + 1, int(np.searchsorted(ends[past], ends[first[r]] + POINTS, side="right")))
        own = slice(first[r], past[to - 1])
        made.append(even_odd_of_many(xy[ends[own.start] : ends[own.stop]], sizes[own], owner[own]))
        r = to
    points, sizes, polygons = (np.concatenate(v) for v in zip(*made)) if made else (np.zeros((0, 2)), np.zeros(0, int), np.zeros(0, int))
    return _lists(points, sizes, np.bincount(polygons, minlength=len(rows)), column.is_null().to_numpy(zero_copy_only=False))


def repaired(shapes: DataFrame, ring: str = "ring", to: str = "rings") -> DataFrame:
    """Add ``to``: simple rings around what lies in an odd number of windings of ``ring`` (a ring, or an array of rings).

    Outer rings run counterclockwise and holes clockwise, so that their signed areas add up; they
    touch in single points at most.  NULL stays NULL; rings without area give an empty array;
    points with a missing coordinate are left out.
    """
    several = isinstance(shapes.schema[ring].dataType.elementType, T.ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ring))
            kept = [n for n in batch.schema.names if n != to]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], _repaired(column, several)], names=[*kept, to])

    fields = [f for f in shapes.schema.fields if f.name != to]
    return shapes.mapInArrow(run, T.StructType([*fields, T.StructField(to, RINGS)]))
