"""Polygons of many sides as cells: each knows its own sides and whether its corner is inside.

A polygon's cells are 1 / ACROSS of its longer side, a power of two, so that a few levels hold
polygons of all sizes.  A shape meets a polygon in cells of the polygon's level, or, if it is larger
than these, of its own size: it goes to one cell a level, that of its lower-left corner, and the
sides go to every cell from which a shape no larger than the cell may reach them.  No expression
meets all sides of a polygon for a pair: a ring is inside, or meets the border, by the sides of
its one cell.

Whether a point is inside follows from the cell's corner: the parity of the sides left of the
corner, changed by each side between the corner and the point, along the lower edge and then
upwards.  Sides through a corner or a point are taken as if corner and point lay a little more
to the right and, by much less, higher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

#: Cells along a polygon's longer side: more than half of this, at most this.
ACROSS = 64


def _level(box: Column) -> Column:
    side = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    return F.when(side > 0, F.ceil(F.log2(side / ACROSS))).otherwise(0).cast("int")


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _at(x: Column, size: Column) -> Column:
    return F.floor(x / size).cast("long")


def _crossing(e: Column, along: str, at: Column) -> Column:
    """Where a side meets the line at a height (``along`` x) or an abscissa (``along`` y)."""
    other = "y" if along == "x" else "x"
    a, b = e["a"], e["b"]
    return a[along] + F.try_divide(at - a[other], b[other] - a[other]) * (b[along] - a[along])


def _spans(e: Column, axis: str, at: Column) -> Column:
    return (e["a"][axis] <= at) != (e["b"][axis] <= at)


def index(polygons: DataFrame, key: str, polygon: str, classes: list[int] | None = None) -> DataFrame:
    """(key, own, level, ix, iy, inside, sides) of the cells of each polygon, those outside left out.

    ``own`` is the polygon's level.  Without ``classes`` the cells serve points; with them,
    shapes no larger than a cell, and a polygon also has cells of each class above its own level.
    ``polygon`` is a ring or an array of rings.
    """
    several = isinstance(polygons.schema[polygon].dataType.elementType, T.ArrayType)
    rings = F.col(polygon) if several else F.array(polygon)
    known = polygons.select(key, rings.alias("_rings")).withColumn("_box", G.rings_bounds(F.col("_rings"))).where("_box.minx IS NOT NULL")
    known = known.withColumn("own", _level(F.col("_box")))
    above = F.filter(F.array(*[F.lit(c) for c in classes or []]).cast("array<int>"), lambda c: c > F.col("own"))
    known = known.withColumn("level", F.explode(F.concat(F.array("own"), above)))
    size = _size(F.col("level"))
    wide = high = F.lit(0.0) if classes is None else size
    e = F.col("e")
    sides = known.select(key, "own", "level", F.explode(G.rings_edges(F.col("_rings"))).alias("e")).where("e.a <> e.b")
    # One column of cells after the other, each with the heights of the side there: long sides reach few cells.
    low, top = F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])
    dealt = sides.withColumn("ix", F.explode(F.sequence(_at(low - wide, size) - (low - wide == _at(low - wide, size) * size).cast("long"), _at(top, size))))
    x0 = F.col("ix") * size
    ends = [F.greatest(low, F.least(x0, top)), F.least(top, F.greatest(low, x0 + size + wide))]
    ys = [F.when(low == top, v).otherwise(_crossing(e, "y", x)) for v, x in zip((e["a"]["y"], e["b"]["y"]), ends)]
    slack = size * 1e-9
    y_low, y_high = F.least(*ys) - slack - high, F.greatest(*ys) + slack
    dealt = dealt.withColumn("iy", F.explode(F.sequence(_at(y_low, size), _at(y_high, size))))
    at = ["own", "level", "iy", "ix"]
    # Crossings of the cells' lower edges change the parity of all corners to their right: of the first at or beyond them.
    rows = F.sequence(_at(F.least(e["a"]["y"], e["b"]["y"]), size), _at(F.greatest(e["a"]["y"], e["b"]["y"]), size))
    crossed = sides.withColumn("iy", F.explode(rows)).where(_spans(e, "y", F.col("iy") * size))
    crossed = crossed.select(key, "own", "level", "iy", F.ceil(_crossing(e, "x", F.col("iy") * size) / size).cast("long").alias("ix"), F.lit(None).cast(_SIDE).alias("e"), F.lit(1).alias("n"), F.lit(False).alias("cell"))
    b = F.col("_box")
    cells = known.withColumn("ix", F.explode(F.sequence(_at(b["minx"] - wide, size) - 1, _at(b["maxx"], size) + 1)))
    cells = cells.withColumn("iy", F.explode(F.sequence(_at(b["miny"] - high, size) - 1, _at(b["maxy"], size))))
    cells = cells.select(key, *at, F.lit(None).cast(_SIDE).alias("e"), F.lit(0).alias("n"), F.lit(True).alias("cell"))
    every = cells.unionByName(crossed).unionByName(dealt.select(key, *at, "e", F.lit(0).alias("n"), F.lit(False).alias("cell")))
    # One exchange: rows of cells stay where they are for their cells' sides and for the sums along them.
    met = every.repartition(key, "own", "level", "iy").groupBy(key, *at).agg(F.sum("n").alias("n"), F.collect_list("e").alias("sides"), F.max("cell").alias("cell"))
    row = Window.partitionBy(key, "own", "level", "iy").orderBy("ix")
    out = met.withColumn("inside", F.sum("n").over(row) % 2 == 1).where("cell AND (inside OR size(sides) > 0)")
    return out.select(key, "own", "level", "ix", "iy", "inside", "sides")


def _inside(x: Column, y: Column, x0: Column, y0: Column, inside: Column, sides: Column) -> Column:
    """Whether a point to the upper right of a cell's corner is inside, by the sides between the two."""

    def changes(e: Column) -> Column:
        x_at = _crossing(e, "x", y0)
        along = _spans(e, "y", y0) & (x_at > x0) & (x_at <= x)
        y_at, rise = _crossing(e, "y", x), (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])
        above = (y_at > y0) | ((y_at == y0) & (rise > 0))
        below = (y_at < y) | ((y_at == y) & (rise <= 0))
        up = _spans(e, "x", x) & above & below
        return along.cast("int") + up.cast("int")

    n = F.aggregate(F.coalesce(sides, F.array().cast(f"array<{_SIDE}>")), F.lit(0), lambda s, e: s + changes(e))
    return (inside.cast("int") + n) % 2 == 1


_SIDE = "struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>"


def _dealt(shapes: DataFrame, levels: list[int], x: Column, y: Column) -> DataFrame:
    """Each shape once a level, in its cell."""
    many = shapes.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = _size(F.col("level"))
    return many.withColumns({"ix": _at(x, size), "iy": _at(y, size)})


def _levels(polygons: DataFrame, polygon: str) -> list[int]:
    """Levels in use: powers of two between the sizes of the smallest and the largest polygon, some ten or twenty."""
    several = isinstance(polygons.schema[polygon].dataType.elementType, T.ArrayType)
    box = (G.rings_bounds if several else G.bounds)(F.col(polygon))
    return sorted(polygons.select(box.alias("b")).where("b.minx IS NOT NULL").agg(F.collect_set(_level(F.col("b")))).first()[0])


def points_within(points: DataFrame, polygons: DataFrame, key: str, polygon: str, x: str = "x", y: str = "y", outside: bool = False) -> DataFrame:
    """Points with the key of each polygon that holds them.

    ``outside``: all points, of a single polygon; NULL for those that it does not hold.
    """
    levels = _levels(polygons, polygon)
    if not levels:
        return points.join(polygons.select(key).limit(0), how="left" if outside else "cross")
    met = _dealt(points, levels, F.col(x), F.col(y)).join(index(polygons, key, polygon), ["level", "ix", "iy"], "left" if outside else "inner")
    size = _size(F.col("level"))
    held = F.col(key).isNotNull() & _inside(F.col(x), F.col(y), F.col("ix") * size, F.col("iy") * size, F.coalesce("inside", F.lit(False)), F.col("sides"))
    if outside:
        return met.select(*points.columns, F.when(held, F.col(key)).alias(key))
    return met.where(held).select(*points.columns, key)


def shapes_meeting(shapes: DataFrame, polygons: DataFrame, key: str, polygon: str, ring: str = "ring") -> DataFrame:
    """Shapes (one ring each) with the key of each polygon that they share a point with.

    One pass over the shapes' bounds finds their classes of size, powers of two; each shape is
    sent to one cell a level and is joined there once.
    """
    levels = _levels(polygons, polygon)
    if not levels:
        return shapes.join(polygons.select(key).limit(0), how="cross")
    boxed = shapes.withColumn("_b", G.bounds(F.col(ring))).where("_b.minx IS NOT NULL")
    b = F.col("_b")
    extent = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"])
    boxed = boxed.withColumn("_c", F.when(extent > _size(F.lit(levels[0])), F.ceil(F.log2(extent))).otherwise(levels[0]).cast("int"))
    classes = sorted(boxed.agg(F.collect_set("_c")).first()[0])
    at = F.array_distinct(F.transform(F.array(*[F.lit(v) for v in levels]), lambda v: F.greatest(v, F.col("_c"))))
    dealt = boxed.withColumn("level", F.explode(at))
    size = _size(F.col("level"))
    dealt = dealt.withColumns({"ix": _at(b["minx"], size), "iy": _at(b["miny"], size)})
    met = dealt.join(index(polygons, key, polygon, classes), ["level", "ix", "iy"]).where("own = level OR _c = level")
    first = F.col(ring)[0]
    held = _inside(first["x"], first["y"], F.col("ix") * size, F.col("iy") * size, F.col("inside"), F.col("sides"))
    near = F.transform(F.array(b), lambda box: G.near_sides(F.col("sides"), box))[0]
    meets = F.exists(G.rings_edges(F.array(ring)), lambda e: F.exists(near, lambda f: G.sides_meet(e, f)))
    # A part of the polygon within the shape has its sides in the shape's own cell.
    around = F.exists(near, lambda f: G.contains(F.col(ring), f["a"]["x"], f["a"]["y"]))
    return met.where(held | meets | around).select(*shapes.columns, key)
