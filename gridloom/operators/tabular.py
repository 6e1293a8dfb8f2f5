"""Joins and rearrangements of plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns that are there, whatever their case."""
    known = {c.lower(): c for c in df.columns}
    return df.select([F.col(known[w.lower()]).alias(w) for w in wanted if w.lower() in known])


def drop_first_column(df: DataFrame) -> DataFrame:
    """A row-number column written by other tools."""
    return df.select(df.columns[1:])


def metros(df: DataFrame, name: str = "name", lsad: str | None = None, excluded: str = "PR") -> DataFrame:
    """Metro areas with their states; areas in the excluded state go."""
    own = df.where(F.col(lsad) == "M1") if lsad else df
    return own.withColumn("states", strings.states(F.col(name))).where(~F.array_contains("states", excluded))


def by_state(df: DataFrame) -> DataFrame:
    """A row for each metro and state, with whether the metro has several."""
    return df.select("*", F.explode("states").alias("state"), (F.size("states") > 1).alias("several"))


def with_population(metros_: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """Left join; metros without population stay."""
    return metros_.join(population, key, "left")


def with_volumes(metros_: DataFrame, volumes: DataFrame, key: str = "name", fixes: dict[str, str] | None = None) -> DataFrame:
    """Inner join on the name, after spelling fixes given as a dict."""
    if fixes:
        table = F.create_map(*[F.lit(v) for kv in fixes.items() for v in kv])
        volumes = volumes.withColumn(key, F.coalesce(F.try_element_at(table, F.col(key)), F.col(key)))
    return metros_.join(volumes, key).where("vols > 0")


def tile_layers(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target tiles with their source; a missing source raises when its row is read."""
    met = target.join(source.withColumn("_there", F.lit(True)), list(key), "left")
    return met.where(F.assert_true(F.coalesce("_there", F.lit(False)), "a target tile has no source tile").isNull()).drop("_there")


def loss_curves(frames: dict[str, DataFrame]) -> DataFrame:
    """Curves of several runs under one another, with the run's name as ``lr``."""
    out = None
    for name, df in frames.items():
        own = df.withColumn("lr", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def with_epoch(df: DataFrame, by: str, order: str) -> DataFrame:
    """Add ``epoch`` from 0 in the order of a persisted line number."""
    return df.withColumn("epoch", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def epoch_means(df: DataFrame) -> DataFrame:
    """Mean loss of each epoch's batches."""
    return df.groupBy("lr", "epoch").agg(F.avg("loss").alias("loss"))


def nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n-th row (from 0) in order."""
    return df.orderBy(order).offset(n).limit(1)


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order (a top-n, not a sort)."""
    return df.orderBy(*order).limit(n)


def epochs(df: DataFrame, runs: Sequence[str] | None = None, last: int | None = None, only: int | None = None) -> DataFrame:
    """Rows of some runs, of epochs up to ``last``, or of one epoch."""
    own = df.where(F.col("lr").isin(*runs)) if runs else df
    own = own.where(F.col("epoch") <= last) if last is not None else own
    return own.where(F.col("epoch") == only) if only is not None else own


def model_summary(tiles: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and exact median of per-tile metrics for each model."""
    both = [f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("mean", F.avg), ("median", F.median))]
    return tiles.groupBy(by).agg(*both)
