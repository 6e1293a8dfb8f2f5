"""Deterministic sampling: rows are ordered by an arithmetic hash of their key.

The same seed gives the same sample however rows are partitioned, and on other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ORDER_SPAN, order_hash


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (a top-n, not a sort); fewer rows than n raise when used."""
    ordered = df.withColumn("_h", order_hash(F.col(key), seed)).orderBy("_h", key).limit(n)
    return ordered.drop("_h")


def checked_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``sample`` that refuses to take more rows than there are (one count)."""
    there = df.count()
    if n > there:
        raise ValueError(f"{n} rows wanted, {there} available")
    return sample(df, key, n, seed)


def split(df: DataFrame, key: str, n: int, seed: int = 42, names: tuple[str, str] = ("test", "train")) -> DataFrame:
    """Add ``split``: n sampled rows get the first name; no row moves."""
    chosen = sample(df.select(key), key, n, seed).withColumn("_s", F.lit(True))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_s"), names[0]).otherwise(names[1])).drop("_s")


def covering_sample(positions: DataFrame, key: str, n: int, seed: int = 42, value: str = "value", keys: DataFrame | None = None) -> DataFrame:
    """(key): one position for each distinct value, then hash order up to ``n``.

    ``positions`` has a row for each value of each position; ``keys`` the positions themselves,
    once each, where that is cheaper to have.  Raises if there are more values than n; takes all
    positions if there are too few.
    """
    h = order_hash(F.col(key), seed)
    firsts = positions.groupBy(value).agg(F.min(F.struct(h.alias("h"), F.col(key).alias("k"))).alias("x")).limit(n + 1).collect()  # n + 1 rows at most
    if len(firsts) > n:
        raise ValueError(f"more than {n} values do not fit into {n} positions")
    every = positions.select(key).distinct() if keys is None else keys.select(key)
    kept = sorted({r["x"]["k"] for r in firsts})
    late = F.when(F.col(key).isin(kept), 0).otherwise(1) if len(kept) <= 1000 else None
    if late is None:
        known = positions.sparkSession.createDataFrame([(k, 0) for k in kept], f"{key} {every.schema[key].dataType.simpleString()}, _late int")
        every = every.join(F.broadcast(known), key, "left")  # n rows at most
        late = F.coalesce("_late", F.lit(1))
    ranked = every.withColumns({"_late": late, "_h": order_hash(F.col(key), seed)})
    return ranked.orderBy("_late", "_h", key).limit(n).select(key)


def first_by_hash(df: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """(by, key): one pseudo-random key of each group, by an aggregate."""
    return df.groupBy(by).agg(F.min_by(F.col(key), F.struct(order_hash(F.col(key), seed), F.col(key))).alias(key))


def global_rank(df: DataFrame, order: Column, key: str, span: int = ORDER_SPAN, buckets: int = 1024) -> DataFrame:
    """Add ``rank`` from 0 in the order of a hash in 0..span-1 (ties by key), without one task sorting all.

    Ranks within hash ranges plus the ranges' offsets: ``buckets`` rows are broadcast at most.
    """
    placed = df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / (span // buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over ``buckets`` rows at most
    offsets = placed.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_at"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)) - 1)
    return ranked.join(F.broadcast(offsets), "_b").withColumn("rank", F.col("_r") + F.col("_at")).drop("_b", "_o", "_r", "_at")


def minibatches(df: DataFrame, key: str, epoch: int, size: int = 128) -> DataFrame:
    """Add ``batch``: an epoch's shuffled batches of ``size`` rows."""
    ranked = global_rank(df, order_hash(F.col(key), epoch), key)
    return ranked.withColumn("batch", F.floor(F.col("rank") / size)).drop("rank")
