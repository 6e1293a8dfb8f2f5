"""Rasters from one reference system and grid onto another, as a join of blocks.

The target is cut into blocks; each knows where its pixels lie in the source from a coarse net of
exact transformations, interpolated between, unless the middles of the net's meshes show an
error over ``tolerance`` source pixels: then every pixel of the block is transformed.  Source
pixels are packed into blocks with one more row and column than their own, so that the four
neighbours of a place lie in one block.  Pixels are shuffled once, to be packed; what meets the
packed blocks are the numbers of the target's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projections

#: Pixels along a source block's side, and meshes of the net along a target block's.
BLOCK, MESHES = 64, 4


def place(target: dict[str, float], target_system, source: dict[str, float], source_system, row: Column, col: Column) -> Column:
    """(u, v): where a place of the target grid (in pixels, from its corner) lies in the source's, NULL if nowhere."""
    x = target["c"] + col * target["a"] + row * target["b"]
    y = target["f"] + col * target["d"] + row * target["e"]
    at = projections.between(target_system, source_system, x, y)
    a, b, c, d, e, f = (source[k] for k in "abcdef")
    det = a * e - b * d


    def pixel(p: Column) -> Column:
        dx, dy = p["x"] - c, p["y"] - f
        return F.struct(((dx * e - dy * b) / det).alias("u"), ((dy * a - dx * d) / det).alias("v"))

    def known(p: Column) -> Column:
        ok = (F.abs(p["u"]) < 1e9) & (F.abs(p["v"]) < 1e9)  # NaN is larger than any number
        return F.struct(F.when(ok, p["u"]).alias("u"), F.when(ok, p["v"]).alias("v"))

    return projections.let(projections.let(at, pixel), known)


def pack(px: DataFrame, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(sr, sc, data): dense row-major blocks of (size + 1)^2 doubles; NULL where there is no pixel."""
    side = size + 1

    def homes(at: str) -> Column:
        b, i = F.floor(F.col(at) / size).cast("int"), F.pmod(F.col(at), F.lit(size))
        own = F.struct(b.alias("b"), i.cast("int").alias("i"))
        return F.when(i == 0, F.array(own, F.struct((b - 1).alias("b"), F.lit(size).alias("i")))).otherwise(F.array(own))

    rows = px.where(F.col(value).isNotNull()).select(F.explode(homes("row")).alias("r"), F.col("col"), F.col(value).cast("double").alias("v"))
    rows = rows.select("r", F.explode(homes("col")).alias("c"), "v")
    grouped = rows.groupBy(F.col("r.b").alias("sr"), F.col("c.b").alias("sc")).agg(F.collect_list(F.struct((F.col("r.i") * side + F.col("c.i")).alias("i"), "v")).alias("p"))
    all_ = F.sequence(F.lit(0), F.lit(side * side - 1))
    gaps = F.transform(F.array_except(all_, F.transform("p", lambda p: p["i"])), lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("v")))
    return grouped.select("sr", "sc", F.transform(F.sort_array(F.concat("p", gaps)), lambda p: p["v"]).alias("data"))


def _meshed(net: Column, p: Column, q: Column, mesh: float) -> Column:
    """Between the net's points: ``p`` rows and ``q`` columns (in pixels) into the block."""
    i, j = (F.least(F.floor(v / mesh), F.lit(MESHES - 1)).cast("int") for v in (p, q))
    s, t = p / mesh - i, q / mesh - j
    at = lambda di, dj: F.get(net, (i + di) * (MESHES + 1) + j + dj)
    mix = lambda k: (1 - s) * ((1 - t) * at(0, 0)[k] + t * at(0, 1)[k]) + s * ((1 - t) * at(1, 0)[k] + t * at(1, 1)[k])
    return F.struct(mix("u").alias("u"), mix("v").alias("v"))


def warp(
    px: DataFrame,
    source: dict[str, float],
    source_system,
    target: dict[str, float],
    target_system,
    height: int,
    width: int,
    method: str = "bilinear",
    value: str = "value",
    tolerance: float = 0.125,
) -> DataFrame:
    """(row, col, value) of all pixels of the target grid; NULL outside the source.

    ``nearest`` takes the pixel that holds the target's centre; ``bilinear`` weighs the four around
    it, NULL ones left out.  Systems: whatever ``projections.system`` takes.  ``tolerance`` bounds,
    in source pixels, what the net's meshes may be off in their middles; 0 transforms every pixel.
    """
    spark = px.sparkSession
    # A target block spans about one source block: where the target is coarser, it has fewer pixels.
    exact = lambda r, c: place(target, target_system, source, source_system, r, c)
    middle = spark.range(1).select(*[exact(F.lit(height / 2 + dr), F.lit(width / 2 + dc)).alias(n) for n, dr, dc in (("o", 0.0, 0.0), ("r", 1.0, 0.0), ("c", 0.0, 1.0))]).first()
    steps = [abs(middle[n][k] - middle["o"][k]) for n in "rc" for k in "uv" if middle[n][k] is not None and middle["o"][k] is not None]
    side = int(max(MESHES, min(BLOCK, BLOCK / max([*steps, 1e-9])))) // MESHES * MESHES
    mesh = side / MESHES
    down, across = -(-height // side), -(-width // side)
    first_row, first_col = F.col("bi") * side, F.col("bj") * side

    def netted(blocks: DataFrame) -> DataFrame:
        """Blocks with their net, and whether it is good enough."""
        points = F.sequence(F.lit(0), F.lit((MESHES + 1) ** 2 - 1))
        net = F.transform(points, lambda k: exact(first_row + F.floor(k / (MESHES + 1)) * mesh, first_col + k % (MESHES + 1) * mesh))
        known = blocks.withColumn("net", net)

        def error(k: Column) -> Column:
            p, q = (F.floor(k / MESHES) + 0.5) * mesh, (k % MESHES + 0.5) * mesh
            pair = F.struct(exact(first_row + p, first_col + q).alias("x"), _meshed(F.col("net"), p, q, mesh).alias("y"))
            return F.transform(F.array(pair), lambda z: F.greatest(F.abs(z["x"]["u"] - z["y"]["u"]), F.abs(z["x"]["v"] - z["y"]["v"])))[0]

        errors = F.transform(F.sequence(F.lit(0), F.lit(MESHES**2 - 1)), error)
        # NULL (a place that is nowhere) is not good enough.
        good = F.lit(tolerance > 0) & F.forall(errors, lambda x: F.coalesce(x <= tolerance, F.lit(False))) & F.forall("net", lambda n: n["u"].isNotNull())
        return known.withColumn("good", good)

    def pixels(blocks: DataFrame) -> DataFrame:
        """One row for each pixel of the blocks: its place, and the block that holds its first neighbour."""
        each = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k"))
        r, c = F.floor(F.col("k") / side).cast("int"), (F.col("k") % side).cast("int")
        each = each.withColumns({"row": (first_row + r).cast("int"), "col": (first_col + c).cast("int")}).where((F.col("row") < height) & (F.col("col") < width))
        at = F.when(F.col("good"), _meshed(F.col("net"), r + 0.5, c + 0.5, mesh)).otherwise(exact(F.col("row") + 0.5, F.col("col") + 0.5))
        back = 0.0 if method == "nearest" else 0.5
        # A generator, so that no filter above computes places again.
        each = each.select("*", F.inline(F.array(at)).alias("_u", "_v")).withColumns({"u": F.col("_u") - back, "v": F.col("_v") - back})
        return each.withColumns({"sr_": F.coalesce(F.floor(F.col("v") / BLOCK).cast("int"), F.lit(-(1 << 30))), "sc_": F.coalesce(F.floor(F.col("u") / BLOCK).cast("int"), F.lit(-(1 << 30)))})

    numbered = spark.range(down * across).select(F.floor(F.col("id") / across).cast("int").alias("bi"), (F.col("id") % across).cast("int").alias("bj"))
    pairs = pixels(netted(numbered)).select("bi", "bj", F.col("sr_").alias("sr"), F.col("sc_").alias("sc")).distinct()
    met = pixels(netted(pairs.join(pack(px, value), ["sr", "sc"], "left"))).where("sr = sr_ AND sc = sc_")
    i, j = F.floor("v").cast("int"), F.floor("u").cast("int")
    tap = lambda dr, dc: F.get("data", (i - F.col("sr") * BLOCK + dr) * (BLOCK + 1) + j - F.col("sc") * BLOCK + dc)
    if method == "nearest":
        return met.select("row", "col", tap(0, 0).alias(value))
    fy, fx = F.col("v") - i, F.col("u") - j
    taps = F.array(*[F.struct(tap(dr, dc).alias("x"), ((fx if dc else 1 - fx) * (fy if dr else 1 - fy)).alias("w")) for dr in (0, 1) for dc in (0, 1)])
    known = F.filter(taps, lambda t: t["x"].isNotNull() & (t["w"] > 0))
    sums = F.aggregate(known, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, t: F.struct((a["s"] + t["w"] * t["x"]).alias("s"), (a["w"] + t["w"]).alias("w")))
    return met.select("row", "col", F.transform(F.array(sums), lambda a: F.try_divide(a["s"], a["w"]))[0].alias(value))
