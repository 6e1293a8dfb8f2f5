"""Text parsing: footprints, centroids, names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centroid(c: Column, numeric: bool = True) -> tuple[Column, Column]:
    """(lat, lon) of ``lat/lon`` text; parts that are no numbers become NULL (or stay text)."""
    parts = F.split(c, "/")
    lat, lon = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return (lat.try_cast("double"), lon.try_cast("double")) if numeric else (lat, lon)


def ring(c: Column, always_close: bool = False) -> Column:
    """``lat/lon_lat/lon_...`` as a closed ring of (x = lon, y = lat).

    NULL if a point is malformed or there are fewer than three; closed if open, or always.
    """
    parts = F.transform(F.filter(F.split(c, "_"), lambda p: p != ""), lambda p: F.split(p, "/"))
    number = lambda p, i: F.try_element_at(p, F.lit(i)).try_cast("double")

    def closed(points: Column) -> Column:
        bad = F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull())
        first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
        out = F.concat(points, F.array(first))
        if not always_close:
            out = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), points).otherwise(out)
        return F.when((F.size(points) >= 3) & ~bad, out)

    # An array of one: the text is split once, not wherever its points are named.
    points = F.transform(parts, lambda p: F.struct(number(p, 2).alias("x"), number(p, 1).alias("y")))
    return F.element_at(F.transform(F.array(points), closed), 1)


def states(name: Column) -> Column:
    """``City, AA-BB`` to the array of its states."""
    return F.split(F.replace(F.try_element_at(F.split(name, ","), F.lit(2)), F.lit(" "), F.lit("")), "-")


def stem(file_name: Column, extension: str) -> Column:
    """File name without path and extension."""
    base = F.element_at(F.split(file_name, "/"), -1)
    return F.regexp_replace(base, rf"\.{extension}$", "")


def drop_prefix(names: dict, prefix: str = "module.") -> dict:
    """Parameter names without a wrapper's prefix."""
    return {k.removeprefix(prefix): v for k, v in names.items()}


def equation(slope: Column, intercept: Column, r2: Column) -> Column:
    """``y = ax + b`` with the sign of b, and R squared."""
    sign = F.when(intercept >= 0, "+").otherwise("-")
    return F.format_string("y = %.2fx %s %.2f, R2 = %.2f", slope, sign, F.abs(intercept), r2)


def slope_label(slope: Column, low: Column, high: Column) -> Column:
    """Slope with its interval."""
    return F.format_string("%.2f [%.2f, %.2f]", slope, low, high)
