"""The study's entry points, composed from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..functions import strings
from ..operators import inference, raster, sampling, stats, tabular, vector


def building_volumes(buildings: DataFrame) -> DataFrame:
    """Parsed footprints, metres capped at 75, volume."""
    # Exploded, not filtered: a filter would parse the text once more, below the exchange, in the few tasks that read.
    parsed = buildings.withColumn("geometry", F.explode(F.array_compact(F.array(strings.ring(F.col("footprint"))))))
    parsed = parsed.withColumns({"area": G.area(F.col("geometry")), "height": S.capped(S.feet_to_metres(F.col("height_ft")), S.HEIGHT_CAP_M), "box": G.bounds(F.col("geometry"))})
    return parsed.withColumn("volume", S.volume(F.col("area"), F.col("height")))


def taylor(buildings: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """(size, cells, mean, variance) of volume over fishnets of all sizes, and over buildings.

    A building counts whole in every cell that it touches.
    """
    own = building_volumes(buildings).select("id", "area", "volume", F.col("box").alias("bbox"))
    # One pass for all that needs every building first: the extent and the buildings' own row.
    box = F.col("bbox")
    ends = [F.min(box["minx"]).alias("minx"), F.min(box["miny"]).alias("miny"), F.max(box["maxx"]).alias("maxx"), F.max(box["maxy"]).alias("maxy")]
    single = vector.shape_aggregates("area", "volume")
    known = own.agg(*ends, *single).first()
    one = own.sparkSession.range(1).select(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(known.__fields__, known, ["double"] * 5 + ["bigint"] + ["double"] * 2)])
    cells = vector.cells_of(own, sizes, one.select("minx", "miny", "maxx", "maxy"))
    return vector.cell_scaling(cells, "volume").unionByName(one.select("size", "cells", "mean", "variance"))


def taylor_fit(scaling: DataFrame, critical: float | None = None) -> DataFrame:
    """ln variance on ln mean."""
    logs = scaling.select(S.guarded_ln(F.col("mean")).alias("x"), S.guarded_ln(F.col("variance")).alias("y"))
    return stats.ols(logs, "x", "y", critical=critical)


def metro_volumes(buildings: DataFrame, metros: DataFrame, cap_multistate: bool = False) -> DataFrame:
    """(metro, name, vols): volume of the buildings that touch each metro.

    Heights are capped in single-state metros, and in the others if ``cap_multistate``.
    """
    known = tabular.metros(metros).withColumn("several", F.size("states") > 1)
    met = vector.within_polygons(buildings, known)
    metres = S.feet_to_metres(F.col("height_ft"))
    capped = S.capped(metres, S.HEIGHT_CAP_M)
    h = capped if cap_multistate else F.when(F.col("several"), metres).otherwise(capped)
    return met.withColumn("v", S.volume(G.area(F.col("ring")), h)).groupBy("metro", "name").agg(F.sum("v").alias("vols"))


def volume_population(volumes: DataFrame, population: DataFrame) -> DataFrame:
    """ln volume on ln population with classical and robust errors, t intervals (95 %) and the slope's p-value; one row."""
    met = tabular.with_population(volumes.where("vols > 0"), population, "metro")
    logs = met.select(S.guarded_ln(F.col("pop").cast("double")).alias("x"), S.guarded_ln(F.col("vols")).alias("y"))
    ends = [f"{c}_{e}" for c in ("slope", "intercept") for e in ("low", "high")]
    classical = stats.inference(stats.ols(logs, "x", "y")).select("n", "slope", "intercept", "r2", "stderr", "p_value", *ends)
    robust = stats.robust_ols(logs, "x", "y").select("slope_hc0", "intercept_hc0")
    return classical.join(F.broadcast(robust))  # one row each


def changed_pixels(px: DataFrame) -> DataFrame:
    """Observed and predicted values where the class changed to an urban one."""
    changed = (F.col("proj") != F.col("cur")) & F.col("proj").isin(*S.URBAN_CHANGE)
    return px.where(changed)


def evaluate(px: DataFrame) -> DataFrame:
    """(kind, n, slope, intercept, r2, r): regressions of observed on predicted fractions and heights, in one pass."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.col(made).cast("double").alias("made"), F.col(real).cast("double").alias("real")) for kind, real, made in (("bf", "bf", "bfp"), ("bh", "bh", "bhp"))]
    each = stats.pairs(changed_pixels(px).select(F.inline(F.array(*rows))), "made", "real")
    y, x = F.col("real"), F.col("made")
    return each.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), stats.correlation("made", "real").alias("r")
    )


def infer_and_override(px: DataFrame, height: int, width: int, predictors, size: int, stride: int, latent=None) -> DataFrame:
    """(row, col, bf, bh): chained predictions; unchanged pixels keep what was observed, no height without fraction.

    Fractions and metres are averaged over windows, not their codes: heights are coded by their
    logarithm.
    """
    coded = px.select("row", "col", S.to_model(S.valid_class(F.col("proj")), S.MAX_CLASS).alias("value"))
    made = inference.infer(coded, height, width, predictors, ["bf_model", "bh_model"], size, stride, decode={"bf_model": S.from_model, "bh_model": S.height_from_model}, latent=latent)
    met = px.join(made, ["row", "col"])
    same = F.col("proj").eqNullSafe(F.col("cur"))
    bf = F.when(same, F.col("bf")).otherwise(F.col("bf_model"))
    bh = F.when(same, S.capped(S.feet_to_metres(F.col("bh")), S.HEIGHT_CAP_M)).otherwise(F.col("bh_model"))
    out = met.select("row", "col", bf.alias("bf"), bh.alias("_bh"))
    return out.select("row", "col", "bf", F.when(F.col("bf") == 0, 0.0).otherwise(F.col("_bh")).alias("bh"))


def training_tiles(px: DataFrame, height: int, width: int, size: int, n: int, held_out: int, seed: int = 42) -> DataFrame:
    """(k, row, col, split): tiles of valid pixels that cover all classes, split for testing."""
    windows = raster.valid_windows(px.withColumn("valid", F.col("cur") > 0), "valid", size, height, width)
    values = raster.window_values(px.select("row", "col", F.col("cur").alias("value")), windows, size)
    keyed = values.withColumn("k", F.col("row").cast("long") * width + F.col("col"))
    chosen = sampling.covering_sample(keyed, "k", n, seed, keys=windows.select((F.col("row").cast("long") * width + F.col("col")).alias("k")))
    split = sampling.split(chosen, "k", held_out, seed + 1)
    return split.select("k", F.floor(F.col("k") / width).cast("int").alias("row"), (F.col("k") % width).cast("int").alias("col"), "split")


def test_tiles(px: DataFrame, existing: DataFrame, size: int, n: int, height: int, width: int, seed: int) -> DataFrame:
    """(k, row, col): hash-ordered windows on developed pixels, whole, off existing tiles, without class 0.

    No rejection loop: predicates first, then the first n in hash order.
    """
    starts = px.where(F.col("cur").isin(*S.DEVELOPED) & (F.col("row") <= height - size) & (F.col("col") <= width - size)).select("k", "row", "col")
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    boxed = starts.withColumn("bbox", F.struct(x.alias("minx"), y.alias("miny"), (x + size).alias("maxx"), (y + size).alias("maxy")))
    free = vector.outside_boxes(boxed, existing, float(2 * size), key="k").drop("bbox")
    whole = raster.valid_windows(px.withColumn("valid", F.col("cur") != 0), "valid", size, height, width)
    return sampling.sample(free.join(whole, ["row", "col"], "left_semi"), "k", n, seed).select("k", "row", "col")


def validate(tiles: DataFrame, models: dict[str, inference.Predictor], real: str, key: str, latent=None) -> DataFrame:
    """(model, mean and median of per-tile mae and mse) of several models on one test set.

    All models are chained-free predictors of the same tiles; their errors are array folds, so
    that pixels never become rows.  All models of a tile get one latent vector: ``latent``, or
    normal numbers by the key.
    """
    drawn = S.normals(F.col(key), 0, inference.LATENT) if latent is None else latent
    tiles = tiles.withColumn("latent", drawn.cast("array<float>"))
    out = None
    for name, model in models.items():
        made = inference.predict(tiles, [model], ["_made"])
        gaps = F.zip_with("_made", real, lambda a, b: a.cast("double") - b.cast("double"))
        n, zero = F.size("_made"), F.lit(0.0)
        mae = F.aggregate(gaps, zero, lambda s, g: s + F.abs(g)) / n
        mse = F.aggregate(gaps, zero, lambda s, g: s + g * g) / n
        own = made.select(F.lit(name).alias("model"), mae.alias("mae"), mse.alias("mse"))
        out = own if out is None else out.unionByName(own)
    return tabular.model_summary(out, "model", ["mae", "mse"])


def raster_growth(px: DataFrame, before: tuple[str, str], after: tuple[str, str], mask) -> DataFrame:
    """(before, after, change): masked raster volumes (fraction, height in feet) and their change in percent."""
    metres = lambda c: S.capped(S.feet_to_metres(F.col(c)), S.HEIGHT_CAP_M)
    sums = [F.coalesce(F.sum(F.when(mask, S.raster_volume(S.capped(F.col(f), 1.0), metres(h)))), F.lit(0.0)).alias(n) for n, (f, h) in (("before", before), ("after", after))]
    return px.agg(*sums).withColumn("change", S.percent_change(F.col("before"), F.col("after")))
