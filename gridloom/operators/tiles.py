"""Rasters as tables of square tiles: map algebra and windows in which pixels never become rows.

A tile is (tr, tc, data): its place in the grid of tiles and its pixels, row-major, NULL where
there is none.  Tables of tiles are bucketed by place, so that rasters of one grid meet without
an exchange; windows that reach beyond a tile get only the neighbours' borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 64
PLACE = ["tr", "tc"]


def pack(px: DataFrame, size: int = SIZE, value: str = "value") -> DataFrame:
    """Tiles of pixels (row, col, value): one exchange."""
    place = [F.floor(F.col(c) / size).cast("int").alias(t) for c, t in (("row", "tr"), ("col", "tc"))]
    at = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    grouped = px.where(F.col(value).isNotNull()).groupBy(*place).agg(F.collect_list(F.struct(at.alias("i"), F.col(value).alias("v"))).alias("p"))
    all_ = F.sequence(F.lit(0), F.lit(size * size - 1))
    gaps = F.transform(F.array_except(all_, F.transform("p", lambda p: p["i"])), lambda i: F.struct(i.alias("i"), F.lit(None).cast(px.schema[value].dataType).alias("v")))
    return grouped.select(*PLACE, F.transform(F.sort_array(F.concat("p", gaps)), lambda p: p["v"]).alias("data"))


def unpack(tiles: DataFrame, data: Sequence[str], size: int = SIZE) -> DataFrame:
    """Pixels (row, col, one column for each of ``data``); those NULL in all of them are left out."""
    each = tiles.select(*PLACE, F.posexplode(F.arrays_zip(*data)).alias("_i", "_v"))
    row, col = F.col("tr") * size + F.floor(F.col("_i") / size), F.col("tc") * size + F.col("_i") % size
    out = each.select(row.cast("int").alias("row"), col.cast("int").alias("col"), *[F.col("_v")[d].alias(d) for d in data])
    return out.where(reduce(lambda a, b: a | b, [F.col(d).isNotNull() for d in data]))


def save(tiles: DataFrame, table: str, buckets: int) -> None:
    """A table of tiles, bucketed and sorted by place; all rasters of a grid take the same ``buckets``.

    As many as ``spark.sql.shuffle.partitions``, so that borders meet them where they are.
    """
    # One task a bucket, so that each is one file and stays sorted.
    tiles.repartition(buckets, *PLACE).write.mode("overwrite").format("parquet").bucketBy(buckets, *PLACE).sortBy(*PLACE).saveAsTable(table)


def stack(spark: SparkSession, tables: dict[str, str], how: str = "inner") -> DataFrame:
    """Tiles of several bucketed rasters (column name to table) side by side, by place, without an exchange."""
    each = [spark.table(t).withColumnRenamed("data", n) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b.hint("merge"), PLACE, how), each)


def combine(tiles: DataFrame, data: Sequence[str], f: Callable[[Column], Column], to: str) -> DataFrame:
    """Add ``to``: ``f`` of each pixel, a struct with a field for each raster of ``data``."""
    return tiles.withColumn(to, F.transform(F.arrays_zip(*data), f))


def _borders(tiles: DataFrame, reach: int, size: int) -> DataFrame:
    """(tr, tc, top, left, height, width, part): the corner of each tile that other tiles reach, at its place in theirs."""
    steps = -(-reach // size)
    sent = [(i, j) for i in range(steps + 1) for j in range(steps + 1) if i or j]
    far = lambda k: size if not k else min(size, reach - (k - 1) * size)
    to = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(far(i)).alias("h"), F.lit(far(j)).alias("w")) for i, j in sent])
    each = tiles.select(*PLACE, "data", F.inline(to))
    rows = F.sequence(F.lit(0), F.col("h") - 1)
    part = F.flatten(F.transform(rows, lambda r: F.slice("data", r * size + 1, F.col("w"))))
    return each.select((F.col("tr") - F.col("i")).alias("tr"), (F.col("tc") - F.col("j")).alias("tc"), (F.col("i") * size).alias("top"), (F.col("j") * size).alias("left"), F.col("h").alias("height"), F.col("w").alias("width"), part.alias("part"))


def _windows(tiles: DataFrame, reach: int, size: int, ddl: str, f: Callable[[int, int, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Rows of ``f`` of each tile with ``reach`` more pixels to the right and below (values, and which there are).

    Only borders are shuffled where the tiles lie bucketed by place.
    """
    shape = F.struct("top", "left", "height", "width", "part")
    own = tiles.select(*PLACE, "data")
    if reach:
        met = own.join(_borders(tiles, reach, size).groupBy(*PLACE).agg(F.collect_list(shape).alias("borders")), PLACE, "left")
    else:
        met = own.withColumn("borders", F.lit(None).cast("array<struct<top:int,left:int,height:int,width:int,part:array<double>>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tr, tc, data, borders in zip(*(b.column(k) for k in range(4))):
                image, there = np.zeros((size + reach, size + reach)), np.zeros((size + reach, size + reach), bool)
                parts = [(0, 0, size, size, data.values)]
                if borders.is_valid:
                    parts += [(*(p[k].as_py() for k in ("top", "left", "height", "width")), p["part"].values) for p in borders]
                for top, left, h, w, values in parts:
                    known = values.is_valid().to_numpy(zero_copy_only=False).reshape(h, w)
                    image[top : top + h, left : left + w] = np.where(known, values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(h, w), 0)
                    there[top : top + h, left : left + w] = known
                made = f(tr.as_py() * size, tc.as_py() * size, image, there)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))

    return met.mapInArrow(run, ddl)


def _sums(mask: np.ndarray, window: int) -> np.ndarray:
    """How many of each window's pixels are set, by a summed-area table."""
    table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    table[1:, 1:] = mask.cumsum(0, dtype=np.int64).cumsum(1)
    return table[window:, window:] - table[:-window, window:] - table[window:, :-window] + table[:-window, :-window]


def valid_windows(tiles: DataFrame, window: int, size: int = SIZE, valid: Callable[[np.ndarray], np.ndarray] = lambda x: x != 0) -> DataFrame:
    """(row, col) of the stride-1 windows all of whose pixels are there and ``valid``."""

    def of(top: int, left: int, image: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        r, c = np.nonzero(_sums(there & valid(image), window) == window * window)
        return {"row": (r + top).astype(np.int32), "col": (c + left).astype(np.int32)}

    return _windows(tiles, window - 1, size, "row int, col int", of)


def window_values(tiles: DataFrame, window: int, size: int = SIZE, valid: Callable[[np.ndarray], np.ndarray] = lambda x: x != 0) -> DataFrame:
    """(row, col, value): the distinct values inside each valid window; one summed-area table for each value of a tile."""

    def of(top: int, left: int, image: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        whole = _sums(there & valid(image), window) == window * window
        found = [(v, *np.nonzero(whole & (_sums(there & (image == v), window) > 0))) for v in np.unique(image[there])] if whole.any() else []
        empty = [np.zeros(0, np.int64)]
        values = [np.full(len(r), v) for v, r, _ in found]
        return {
            "row": (np.concatenate([r for _, r, _ in found] or empty) + top).astype(np.int32),
            "col": (np.concatenate([c for _, _, c in found] or empty) + left).astype(np.int32),
            "value": np.concatenate(values or [np.zeros(0)]),
        }

    return _windows(tiles, window - 1, size, "row int, col int, value double", of)
