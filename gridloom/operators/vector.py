"""Fishnets and spatial joins as equi-joins on grid cells, and coverage rasterisation.

A geometry is sent to the cells that its bounds touch; pairs meet in common cells and are kept
only in the one that holds the lower-left corner of their common bounds, so that no distinct
is needed afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from . import polygon_index


def fishnet_size(low: Column, high: Column, size: Column, closed: bool) -> Column:
    """Cells along an axis: half-open (up to the end) or closed (one more where it divides)."""
    n = (high - low) / size
    return (F.floor(n) + 1).cast("long") if closed else F.ceil(n).cast("long")


def fishnet(extent: DataFrame, size: float, closed: bool = False) -> DataFrame:
    """(id, ix, iy, minx, miny, maxx, maxy) of an extent's cells; ids from 1, row-major from lower left."""
    s = F.lit(float(size))
    e = extent.select(*["minx", "miny"], fishnet_size(F.col("minx"), F.col("maxx"), s, closed).alias("nx"), fishnet_size(F.col("miny"), F.col("maxy"), s, closed).alias("ny"))
    cells = e.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    x0, y0 = F.col("minx") + F.col("ix") * s, F.col("miny") + F.col("iy") * s
    return cells.select((F.col("iy") * F.col("nx") + F.col("ix") + 1).alias("id"), "ix", "iy", x0.alias("cell_minx"), y0.alias("cell_miny"), (x0 + s).alias("cell_maxx"), (y0 + s).alias("cell_maxy"))


def touched(low: Column, high: Column, origin: Column, size: Column, n: Column) -> Column:
    """Cells of an axis that an interval touches, a shared edge counting."""
    first = F.greatest(F.lit(0).cast("long"), (F.ceil((low - origin) / size) - 1).cast("long"))
    return F.sequence(first, F.greatest(first, F.least(F.floor((high - origin) / size).cast("long"), n - 1)))


def _several(shapes: DataFrame, ring: str) -> bool:
    """Whether the column holds arrays of rings."""
    return isinstance(shapes.schema[ring].dataType.elementType, T.ArrayType)


def _sides(shapes: DataFrame, ring: str) -> Column:
    return (G.rings_edges if _several(shapes, ring) else G.ring_edges)(F.col(ring))


def cells_of(shapes: DataFrame, sizes: Sequence[float], extent: DataFrame, box: str = "bbox", ring: str | None = None) -> DataFrame:
    """Each shape once for every cell (size, ix, iy) of a closed fishnet that it touches.

    All sizes in one job.  With ``ring`` the exact test follows the candidates of the bounds.
    """
    b = F.col(box)
    size = F.col("size")
    if ring:
        shapes = shapes.withColumn("_sides", _sides(shapes, ring))  # once a shape, before its cells
    many = shapes.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    met = many.join(F.broadcast(extent.select(*[F.col(c).alias(f"_{c}") for c in ("minx", "miny", "maxx", "maxy")])))  # one row
    nx, ny = (fishnet_size(F.col(f"_min{a}"), F.col(f"_max{a}"), size, True) for a in "xy")
    met = met.withColumn("ix", F.explode(touched(b["minx"], b["maxx"], F.col("_minx"), size, nx)))
    met = met.withColumn("iy", F.explode(touched(b["miny"], b["maxy"], F.col("_miny"), size, ny)))
    if ring:
        x0, y0 = F.col("_minx") + F.col("ix") * size, F.col("_miny") + F.col("iy") * size
        met = met.where(G.sides_meet_box(F.col("_sides"), x0, y0, x0 + size, y0 + size)).drop("_sides")
    return met.drop("_minx", "_miny", "_maxx", "_maxy")


def cells_left(shapes: DataFrame, sizes: Sequence[float], extent: DataFrame, box: str = "bbox", ring: str | None = None) -> DataFrame:
    """Left join: every cell (size, ix, iy) of the closed fishnets, with each shape that touches it or NULLs."""
    nets = [fishnet(extent, float(s), closed=True).select(F.lit(float(s)).alias("size"), "ix", "iy") for s in sizes]
    return reduce(DataFrame.unionByName, nets).join(cells_of(shapes, sizes, extent, box, ring), ["size", "ix", "iy"], "left")


def cell_scaling(cells: DataFrame, value: str) -> DataFrame:
    """(size, cells, mean, variance) of positive cell totals: sample variance across cells."""
    totals = cells.groupBy("size", "ix", "iy").agg(F.sum(value).alias("total")).where("total > 0")
    return totals.groupBy("size").agg(F.count(F.lit(1)).alias("cells"), F.avg("total").alias("mean"), F.var_samp("total").alias("variance"))


def shape_aggregates(area: str, value: str) -> list[Column]:
    """The columns of ``cell_scaling`` for single shapes: their size is the square root of the least area."""
    return [F.sqrt(F.min(area)).alias("size"), F.count(value).alias("cells"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")]


def join_by_cells(left: DataFrame, right: DataFrame, size: float, test: Callable[[Column, Column], Column], how: str = "inner", left_box: str = "bbox", right_box: str = "box", left_key: str = "id") -> DataFrame:
    """Spatial inner, left_semi or left_anti join; ``test`` takes both bounds columns."""

    def dealt(df: DataFrame, box: str) -> DataFrame:
        b = F.col(box)
        cells = lambda a: F.sequence(F.floor(b[f"min{a}"] / size), F.floor(b[f"max{a}"] / size))
        return df.withColumn("_cx", F.explode(cells("x"))).withColumn("_cy", F.explode(cells("y")))

    lb, rb = F.col(left_box), F.col(right_box)
    one = (F.col("_cx") == F.floor(F.greatest(lb["minx"], rb["minx"]) / size)) & (F.col("_cy") == F.floor(F.greatest(lb["miny"], rb["miny"]) / size))
    met = dealt(left, left_box).join(dealt(right, right_box), ["_cx", "_cy"]).where(one & test(lb, rb)).drop("_cx", "_cy")
    if how == "inner":
        return met
    return left.join(met.select(left_key).distinct(), left_key, how)


def outside_boxes(candidates: DataFrame, existing: DataFrame, size: float, key: str = "id") -> DataFrame:
    """Candidates whose bounds overlap no existing bounds; touching is no overlap.

    Bounds of any number of copies are compared once: different bounds meet, and the candidates
    follow by theirs (``key`` is taken for earlier callers and changes nothing).
    """
    each = candidates.select("bbox").where("bbox IS NOT NULL").distinct()
    met = join_by_cells(each, existing.select("box").distinct(), size, G.boxes_overlap)
    return candidates.join(met.select("bbox").distinct(), "bbox", "left_anti").select(*candidates.columns)


def within_polygons(shapes: DataFrame, polygons: DataFrame, size: float | None = None, ring: str = "ring", polygon: str = "polygon", key: str = "metro") -> DataFrame:
    """Shapes with each polygon (a ring, or an array of rings: holes and parts) that they share a point with.

    By the polygons' index of sides and cells; their other columns follow by ``key``.  Cells follow
    the polygons: ``size`` is taken for earlier callers and changes nothing.
    """
    found = polygon_index.shapes_meeting(shapes, polygons, key, polygon, ring)
    return found.join(polygons.drop(polygon), key)


def coverage(shapes: DataFrame, pixel: float, height: str, ring: str | None = None, box: str = "bbox") -> DataFrame:
    """(row, col, fraction, height): covered share (at most 1) and area-weighted mean height.

    Without ``ring`` shapes are rectangles; else the exact common area with each pixel counts.
    """
    b, s = F.col(box), F.lit(float(pixel))
    cells = lambda a: F.sequence(F.floor(b[f"min{a}"] / s), F.greatest(F.floor(b[f"min{a}"] / s), (F.ceil(b[f"max{a}"] / s) - 1).cast("long")))
    met = shapes.withColumn("col", F.explode(cells("x"))).withColumn("row", F.explode(cells("y")))
    x0, y0 = F.col("col") * s, F.col("row") * s
    if ring and _several(shapes, ring):
        area = G.rings_area_in_box(F.col(ring), x0, y0, x0 + s, y0 + s)
    elif ring:
        area = G.area_in_box(F.col(ring), x0, y0, x0 + s, y0 + s)
    else:
        area = G.box_overlap_area(b, F.struct(x0.alias("minx"), y0.alias("miny"), (x0 + s).alias("maxx"), (y0 + s).alias("maxy")))
    met = met.withColumn("_a", area).where("_a > 0").groupBy("row", "col")
    out = met.agg(F.sum("_a").alias("_w"), F.sum(F.col("_a") * F.col(height)).alias("_s"))
    return out.select("row", "col", F.least(F.col("_w") / (s * s), F.lit(1.0)).alias("fraction"), (F.col("_s") / F.col("_w")).alias("height"))


def burn(shapes: DataFrame, pixel: float, value: str, order: str, box: str = "bbox", ring: str | None = None, touched_too: bool = True) -> DataFrame:
    """(row, col, value): a pixel takes the value of the last shape in order that burns it.

    Without ``ring`` shapes are their bounds.  With it, a pixel counts if the shape touches it,
    or, without ``touched_too``, if it holds the pixel's centre.
    """
    b, s = F.col(box), F.lit(float(pixel))
    cells = lambda a: F.sequence(F.floor(b[f"min{a}"] / s), F.floor(b[f"max{a}"] / s))
    met = shapes
    if ring and touched_too:
        met = met.withColumn("_sides", _sides(met, ring))  # once a shape, before its pixels
    met = met.withColumn("col", F.explode(cells("x"))).withColumn("row", F.explode(cells("y")))
    if ring:
        x0, y0 = F.col("col") * s, F.col("row") * s
        if touched_too:
            met = met.where(G.sides_meet_box(F.col("_sides"), x0, y0, x0 + s, y0 + s))
        else:
            met = met.where((G.rings_contain if _several(met, ring) else G.contains)(F.col(ring), x0 + s / 2, y0 + s / 2))
    return met.groupBy("row", "col").agg(F.max_by(value, order).alias("value"))
