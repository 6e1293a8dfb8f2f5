"""Unit conversion, encodings, guarded arithmetic and binning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and limits of the data.
FEET_PER_METRE = 3.280839895
METRES_PER_FOOT = 0.3048
SQUARE_METRES_PER_SQUARE_FOOT = 0.09290304
HEIGHT_CAP_M = 75.0
MAX_CLASS = 95
PIXEL_AREA_M2 = 900.0
DEVELOPED = (21, 22, 23, 24)
URBAN_CHANGE = (22, 23, 24)
RECODED_TO_ZERO = (1, 4, 7, 8)


def missing(c: Column) -> Column:
    """NaN as NULL, so that comparisons and aggregates treat it as missing."""
    return F.when(~F.isnan(c), c)


def zero_if_missing(c: Column) -> Column:
    """NaN and NULL as 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def capped(c: Column, most: float) -> Column:
    """At most ``most``; NaN and NULL stay missing."""
    return F.when(missing(c).isNotNull(), F.least(c, F.lit(most)))


def feet_to_metres(c: Column, divide: bool = False) -> Column:
    """Either factor in use: multiplication by 0.3048 or division by 3.280839895."""
    return c / F.lit(FEET_PER_METRE) if divide else c * F.lit(METRES_PER_FOOT)


def square_feet_to_square_metres(c: Column) -> Column:
    """Area conversion."""
    return c * F.lit(SQUARE_METRES_PER_SQUARE_FOOT)


def volume(area: Column, height: Column) -> Column:
    """Of a building: footprint times height."""
    return area * height


def raster_volume(fraction: Column, height: Column, pixel_area: float = PIXEL_AREA_M2) -> Column:
    """Of a pixel: built fraction times mean height times its area."""
    return fraction * height * F.lit(pixel_area)


def recode(c: Column, codes=RECODED_TO_ZERO) -> Column:
    """Listed classes as 0."""
    return F.when(c.isin(*codes), 0).otherwise(c)


def valid_class(c: Column) -> Column:
    """Classes outside 0..95 as 0."""
    return F.when((c < 0) | (c > MAX_CLASS), 0).otherwise(c)


def to_model(c: Column, span: float = 1.0) -> Column:
    """0..span to -1..1."""
    return c / F.lit(span) * 2 - 1


def from_model(c: Column, span: float = 1.0) -> Column:
    """-1..1 to 0..span."""
    return (c + 1) / 2 * F.lit(span)


def height_to_model(feet: Column) -> Column:
    """Feet to -1..1 on a log scale capped at 75 m; 0 and 1 m both give -1."""
    m = capped(feet_to_metres(feet, divide=True), HEIGHT_CAP_M)
    return F.when(m > 0, F.ln(m)).otherwise(m) / F.lit(math.log(HEIGHT_CAP_M)) * 2 - 1


def height_from_model(c: Column) -> Column:
    """-1..1 to metres; what was 0 m comes back as 1 m."""
    return F.exp((c + 1) * F.lit(math.log(HEIGHT_CAP_M) / 2))


def guarded_divide(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b where b > 0, else ``otherwise``."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def guarded_ln(c: Column) -> Column:
    """ln where positive, else NULL."""
    return F.when(c > 0, F.ln(c))


def percent_change(before: Column, after: Column) -> Column:
    """100 (after - before) / before, NULL for 0."""
    return F.try_divide((after - before) * 100, before)


def power_law(x: Column, slope: Column, intercept: Column) -> Column:
    """x ** slope * e ** intercept."""
    return F.pow(x, slope) * F.exp(intercept)


def histogram_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0; NULL outside; the last bin holds the upper bound."""
    at = F.floor((c - F.lit(low)) / F.lit(high - low) * bins)
    return F.when((c >= low) & (c <= high), F.least(at, F.lit(bins - 1).cast("long"))).cast("int")


def hexagon(x: Column, y: Column, size_x: float, size_y: float) -> tuple[Column, Column]:
    """Numbers of the nearer of two offset lattices' points, doubled on the offset one."""
    u, v = x / F.lit(size_x), y / F.lit(size_y)
    ax, ay = F.floor(u + 0.5), F.floor(v + 0.5)
    bx, by = F.floor(u), F.floor(v)
    da = F.pow(u - ax, 2) + 3 * F.pow(v - ay, 2)
    db = F.pow(u - bx - 0.5, 2) + 3 * F.pow(v - by - 0.5, 2)
    first = da < db
    return (F.when(first, ax * 2).otherwise(bx * 2 + 1).cast("long"), F.when(first, ay * 2).otherwise(by * 2 + 1).cast("long"))


def reflect(i: Column, n: int) -> Column:
    """Index mirrored into 0..n-1 without repeating the edge, however far outside."""
    if n == 1:
        return i * 0
    period = 2 * (n - 1)
    folded = F.pmod(i, F.lit(period))
    return F.when(folded < n, folded).otherwise(F.lit(period) - folded)


#: Hashes that order rows are below this; products of two numbers below it fit a long.
ORDER_SPAN = 1 << 31


def order_hash(key: Column, seed: int = 42) -> Column:
    """A mixing hash below ORDER_SPAN that other engines compute alike: orders rows for sampling.

    The seed enters before every multiplication, so that each seed gives an order of its own.
    For a fixed upper half of the key and a fixed seed it is a permutation of the lower half.
    """
    m = F.lit(ORDER_SPAN)
    k = key.cast("long")
    high = F.pmod(F.shiftright(k, 31), m)
    h = F.pmod(k, m).bitwiseXOR((high * 40503 + seed_term(seed, 0)) % m)
    for step, (factor, shift) in enumerate(ORDER_ROUNDS, 1):
        h = (h * F.lit(factor) + seed_term(seed, step)) % m
        h = h.bitwiseXOR(F.shiftright(h, shift))
    return h


#: Odd multipliers and shifts of the rounds of ``order_hash``.
ORDER_ROUNDS = ((1597334677, 15), (1812433253, 13), (747796405, 16))


def seed_term(seed: int, step: int) -> int:
    """What a seed adds in a round."""
    return (seed + 1) * (2654435761, 2246822519, 3266489917, 668265263)[step] % ORDER_SPAN


def uniform(key: Column, seed: int, dim: int) -> Column:
    """A hashed number in (0, 1): the same however rows are partitioned."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(dim)), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))


def normals(key: Column, seed: int, dims: int = 8) -> Column:
    """Standard normal numbers by the Box-Muller transform of hashed uniforms."""
    pairs = [F.sqrt(-2 * F.ln(uniform(key, seed, 2 * d))) * F.cos(F.lit(2 * math.pi) * uniform(key, seed, 2 * d + 1)) for d in range(dims)]
    return F.array(*pairs)
