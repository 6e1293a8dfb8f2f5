"""Rasters as pixel rows (row, col, value...): map algebra, blocks, windows, warping.

Georeferences are plain affine dicts (a..f); no operator collects pixels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.scalar import reflect
from . import polygon_index


def window(px: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """A pixel window, its rows and columns counted from its corner."""
    inside = F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1)
    return px.where(inside).withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def bounds_window(px: DataFrame, transform: dict[str, float], left: float, bottom: float, right: float, top: float) -> DataFrame:
    """The window that geographic bounds cover."""
    return window(px, *G.bounds_window(transform, left, bottom, right, top))


def stack(first: DataFrame, *others: DataFrame, keys: Sequence[str] = ("row", "col"), how: str = "inner") -> DataFrame:
    """Positional join of co-registered rasters: one exchange on the pixel key for each."""
    for other in others:
        first = first.join(other, list(keys), how)
    return first


def min_shift(px: DataFrame, value: str = "value", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values less their minimum; a constant raster becomes the middle of low and high.

    The minimum is a one-row aggregate joined back, not an unpartitioned window.
    """
    ends = px.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    moved = F.when(F.col("_lo") == F.col("_hi"), F.lit((low + high) / 2)).otherwise(F.col(value) - F.col("_lo"))
    return px.join(F.broadcast(ends)).withColumn(value, moved).drop("_lo", "_hi")  # one row


def blocks(px: DataFrame, size: int, height: int, width: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of non-overlapping size x size blocks; remainder rows and columns are trimmed."""
    kept = px.where((F.col("row") < height // size * size) & (F.col("col") < width // size * size))
    keys = [F.floor(F.col(c) / size).cast("int").alias(b) for c, b in (("row", "block_row"), ("col", "block_col"))]
    return kept.groupBy(*keys).agg(*aggregates)


def masked(value: str, mask: Column) -> Column:
    """A value where the mask holds: aggregates of nothing are NULL."""
    return F.when(mask, F.col(value))


def clip_to_polygon(px: DataFrame, transform: dict[str, float], ring: Column, value: str = "value", nodata: float | None = 0) -> DataFrame:
    """Crop to the polygon's bounds, re-based; outside of it ``nodata`` (or left out, if None).

    ``ring`` is one ring, or an array of rings (holes, parts).
    """
    one = px.sparkSession.range(1).select(F.lit(0).alias("_polygon"), ring.alias("_ring"))
    several = isinstance(one.schema["_ring"].dataType.elementType, T.ArrayType)
    t = transform
    to_col = lambda v: (v - t["c"]) / t["a"]
    to_row = lambda v: (v - t["f"]) / t["e"]
    b = F.col("_box")
    ends = {
        "_c0": F.floor(F.least(to_col(b["minx"]), to_col(b["maxx"]))),
        "_c1": F.ceil(F.greatest(to_col(b["minx"]), to_col(b["maxx"]))),
        "_r0": F.floor(F.least(to_row(b["miny"]), to_row(b["maxy"]))),
        "_r1": F.ceil(F.greatest(to_row(b["miny"]), to_row(b["maxy"]))),
    }
    box = F.broadcast(one.select((G.rings_bounds if several else G.bounds)(F.col("_ring")).alias("_box")).select(*[v.alias(k) for k, v in ends.items()]))  # one row
    met = px.join(box).where("row >= _r0 AND row < _r1 AND col >= _c0 AND col < _c1")
    # The pixels' centres meet the sides of their own cells of the polygon only.
    centres = met.withColumns({"_x": F.lit(t["c"]) + (F.col("col") + 0.5) * t["a"], "_y": F.lit(t["f"]) + (F.col("row") + 0.5) * t["e"]})
    if nodata is None:
        met = polygon_index.points_within(centres, one, "_polygon", "_ring", "_x", "_y")
    else:
        met = polygon_index.points_within(centres, one, "_polygon", "_ring", "_x", "_y", outside=True)
        met = met.withColumn(value, F.when(F.col("_polygon").isNotNull(), F.col(value)).otherwise(F.lit(nodata)))
    based = {"row": (F.col("row") - F.greatest("_r0", F.lit(0))).cast("int"), "col": (F.col("col") - F.greatest("_c0", F.lit(0))).cast("int")}
    return met.withColumns(based).drop("_polygon", "_x", "_y", *ends)


def aligned(a: dict, b: dict, tolerance: float = 1e-6) -> bool:
    """Whether two rasters' metadata (srid, height, width, transform) describe one grid."""
    same = all(a[k] == b[k] for k in ("srid", "height", "width"))
    return same and all(abs(a["transform"][k] - b["transform"][k]) <= tolerance for k in "abcdef")


def aligned_to(meta: DataFrame, reference: dict, tolerance: float = 1e-6) -> DataFrame:
    """Add ``aligned``: whether each row of rasters' metadata describes the reference's grid.

    Rows without a transform are not aligned; a missing srid equals only a missing one.
    """
    same = [F.col(k).eqNullSafe(F.lit(reference[k])) for k in ("srid", "height", "width")]
    near = [F.abs(F.col("transform")[k] - F.lit(reference["transform"][k])) <= tolerance for k in "abcdef"]
    return meta.withColumn("aligned", F.coalesce(reduce(and_, same + near), F.lit(False)))


def warp(px: DataFrame, source: dict[str, float], target: dict[str, float], height: int, width: int, method: str = "bilinear", value: str = "value") -> DataFrame:
    """Resample onto another grid of the same reference system.

    Every source pixel is sent to the target pixels that use it: nearest takes the pixel that
    holds the target's centre, bilinear weighs the four around it; NULL neighbours weigh nothing.
    """
    spark = px.sparkSession
    grid = spark.range(height).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    x = F.lit(target["c"]) + (F.col("col") + 0.5) * target["a"]
    y = F.lit(target["f"]) + (F.col("row") + 0.5) * target["e"]
    u, v = (x - source["c"]) / source["a"], (y - source["f"]) / source["e"]
    if method == "nearest":
        wanted = grid.withColumns({"_c": F.floor(u).cast("int"), "_r": F.floor(v).cast("int"), "_w": F.lit(1.0)})
    else:
        fx, fy = u - 0.5 - F.floor(u - 0.5), v - 0.5 - F.floor(v - 0.5)
        four = [
            F.struct(
                (F.floor(v - 0.5) + dr).cast("int").alias("_r"),
                (F.floor(u - 0.5) + dc).cast("int").alias("_c"),
                ((fx if dc else 1 - fx) * (fy if dr else 1 - fy)).alias("_w"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
        wanted = grid.select("row", "col", F.inline(F.array(*four))).where("_w > 0")
    known = px.where(F.col(value).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    met = wanted.join(known, ["_r", "_c"], "left").groupBy("row", "col")
    weight = F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))
    return met.agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), weight).alias(value))


def valid_windows(px: DataFrame, valid: str, size: int, height: int, width: int) -> DataFrame:
    """(row, col) of stride-1 windows whose pixels are all valid: two separable sliding sums.

    Pixels must be dense (NULL or false where invalid), since frames count rows.
    """
    ahead = lambda part, order: Window.partitionBy(part).orderBy(order).rowsBetween(0, size - 1)
    across = px.select("row", "col", F.sum(F.coalesce(F.col(valid).cast("int"), F.lit(0))).over(ahead("row", "col")).alias("s"))
    down = across.select("row", "col", F.sum("s").over(ahead("col", "row")).alias("s"))
    return down.where((F.col("s") == size * size) & (F.col("row") <= height - size) & (F.col("col") <= width - size)).select("row", "col")


def window_values(px: DataFrame, windows: DataFrame, size: int, value: str = "value") -> DataFrame:
    """(row, col, value): the distinct values inside each window.

    Sets of runs of 1, 2, 4... pixels are united with those that follow, across and then down,
    so that a window costs some 2 log2(size) unions of small sets; the only rows made are those
    of the result.  Pixels must be dense, since positions count rows.
    """

    def united(df: DataFrame, part: str, order: str) -> DataFrame:
        along, run = Window.partitionBy(part).orderBy(order), 1
        while run < size:
            step = min(run, size - run)
            df = df.withColumn("_v", F.array_union("_v", F.coalesce(F.lead("_v", step).over(along), F.col("_v"))))
            run += step
        return df

    sets = united(united(px.select("row", "col", F.array(F.col(value)).alias("_v")), "row", "col"), "col", "row")
    return windows.select("row", "col").join(sets, ["row", "col"]).select("row", "col", F.explode("_v").alias("value"))


def neighbours(tiles: DataFrame, step: int) -> DataFrame:
    """The nine windows around (and at) each tile, as band 1..9 in row-major order."""
    offsets = F.array(*[F.struct(F.lit(3 * i + j + 1).alias("band"), F.lit((i - 1) * step).alias("_dr"), F.lit((j - 1) * step).alias("_dc")) for i in range(3) for j in range(3)])
    return tiles.select("*", F.inline(offsets)).withColumns({"row0": F.col("row") + F.col("_dr"), "col0": F.col("col") + F.col("_dc")}).drop("_dr", "_dc")


def padded_size(n: int, size: int, stride: int) -> int:
    """At least ``size``, rounded up so that windows at ``stride`` end exactly."""
    n = max(n, size)
    return n + (-(n - size)) % stride


def pad_reflect(px: DataFrame, height: int, width: int, size: int, stride: int) -> DataFrame:
    """Mirror the raster at the bottom and right up to whole windows.

    Each source pixel is sent to its copies: no join, no grid of target pixels.
    """

    def copies(at: str, n: int) -> Column:
        whole = padded_size(n, size, stride)
        return F.filter(F.sequence(F.lit(0), F.lit(whole - 1)), lambda i: reflect(i, n) == F.col(at)) if whole > 2 * n - 1 else _mirrored(at, n, whole)

    rows = px.withColumn("_r", F.explode(copies("row", height))).withColumn("_c", F.explode(copies("col", width)))
    return rows.withColumns({"row": F.col("_r").cast("int"), "col": F.col("_c").cast("int")}).drop("_r", "_c")


def _mirrored(at: str, n: int, whole: int) -> Column:
    """The places of an index and, if padding reaches it, of its one mirror image."""
    image = F.lit(2 * (n - 1)) - F.col(at)
    return F.when((F.col(at) < n - 1) & (image < whole), F.array(F.col(at), image)).otherwise(F.array(F.col(at)))


def covering_windows(px: DataFrame, height: int, width: int, size: int, stride: int) -> DataFrame:
    """Each pixel of a padded raster once for every window (win_row, win_col) that covers it."""

    def starts(at: str, n: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - (size - 1)) / F.lit(stride)))
        return F.sequence(low.cast("int"), F.least(F.lit((n - size) // stride), F.floor(F.col(at) / stride)).cast("int"))

    out = px.withColumn("_i", F.explode(starts("row", height))).withColumn("_j", F.explode(starts("col", width)))
    return out.withColumns({"win_row": F.col("_i") * stride, "win_col": F.col("_j") * stride}).drop("_i", "_j")


def overlap_average(predictions: DataFrame, height: int, width: int, values: Sequence[str]) -> DataFrame:
    """Mean of all predictions of a pixel, cropped to the original extent."""
    kept = predictions.where((F.col("row") < height) & (F.col("col") < width))
    return kept.groupBy("row", "col").agg(*[F.avg(v).alias(v) for v in values])


def to_tiles(px: DataFrame, size: int, value: str = "value", layer: str = "central") -> DataFrame:
    """Pixels of (win_row, win_col) windows as one row-major array a tile."""
    at = (F.col("row") - F.col("win_row")) * size + F.col("col") - F.col("win_col")
    grouped = px.groupBy("win_row", "win_col").agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col(value).cast("float").alias("v")))).alias("_p"))
    return grouped.select(F.lit(layer).alias("layer"), "win_row", "win_col", F.lit(size).alias("size"), F.transform("_p", lambda p: p["v"]).alias("data"))


def from_tiles(tiles: DataFrame, data: str = "data", value: str = "value") -> DataFrame:
    """Tiles back to pixels (row, col, win_row, win_col, value)."""
    out = tiles.select("win_row", "win_col", "size", F.posexplode(data).alias("_i", value))
    return out.select((F.col("win_row") + F.floor(F.col("_i") / F.col("size"))).cast("int").alias("row"), (F.col("win_col") + F.col("_i") % F.col("size")).cast("int").alias("col"), "win_row", "win_col", value)


def degrees_to_pixels(transform: dict[str, float], x: float, y: float) -> tuple[int, int]:
    """(row, col) of the pixel that holds a point."""
    return math.floor((y - transform["f"]) / transform["e"]), math.floor((x - transform["c"]) / transform["a"])
