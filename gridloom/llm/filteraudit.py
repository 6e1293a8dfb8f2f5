"""How quality filters interact: every order of five filters replayed over the whole corpus.

1. Each whole text gets the bits of the filters that it fails; copies are found by the digests of
   their texts, whose smallest ids are written and joined back, so that a crowded digest is split.
2. Each document meets the 120 orders (a constant table, broadcast) and the five steps of each;
   the first step whose filter it fails removes it.
3. Counts of (part, order, step) are conditional sums, combined before they are shuffled: no more
   than 600 rows a part and task leave a task, however many documents it replays.

Everything is built-in functions; text meets no shuffle.

Filters that a document fails: A, under 100 words; B, distinct words under 80 in 100; C, over 10
capital letters A-Z in 100 code points; D, a character of #$%&*|; E, a text that a smaller id has.

Defined cases: null texts are empty: they fail A (and E, if repeated) and no other; null parts
are the empty string, as are empty ones; rows without id fail no E and have no labels; rows that
repeat an id count one by one, and fail no E through each other; a document is good (toxic) if
any of its label rows says so; equal texts are known by SHA-256; very long texts are taken whole;
an empty table gives no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def flags(docs: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """(id, part, fails): bit k of ``fails`` is set if the document fails the k-th of FILTERS."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("t"))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = rows.select("id", "part", "t", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("u"))
    failed = [
        F.col("n") < 100,
        F.col("u") * F.lit(100).cast("long") < F.col("n") * F.lit(80).cast("long"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")) * F.lit(100).cast("long") > F.length("t") * F.lit(10).cast("long"),
        F.col("t").rlike("[#$%&*|]"),
    ]
    bits = sum((x.cast("int") * (1 << k) for k, x in enumerate(failed)), F.lit(0))
    own = materialise(counted.select("id", "part", bits.alias("own"), F.unhex(F.sha2("t", 256)).alias("key")), "audit-flags")
    firsts = own.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    met = own.join(materialise(firsts.select("key", "first"), "audit-copies"), "key", "left")
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return met.select("id", "part", (F.col("own") + late.cast("int") * 16).alias("fails"))


def replay(flagged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each part, order and step with its counts."""
    spark = flagged.sparkSession
    said = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = flagged.join(materialise(said, "audit-labels"), "id", "left")
    # No order is wider than its name, so this table's size is a constant.
    orders = spark.range(1).select(F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    bit = [F.expr(f"shiftleft(1, ascii(substr(filter_order, {k}, 1)) - 65)") for k in range(1, 6)]
    orders = orders.select("filter_order", F.array(*bit).alias("bits"))
    crossed = met.crossJoin(F.broadcast(orders))
    fails = lambda b: F.col("fails").bitwiseAND(b) != 0
    first = F.coalesce(*[F.when(fails(F.col("bits")[k]), F.lit(k + 1)) for k in range(5)], F.lit(6))
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    step, here = F.col("at") + 1, F.col("first") == F.col("at") + 1
    counts = steps.groupBy("part", "filter_order", step.alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails(F.col("bit")) & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    # 120 rows for each part and filter.
    of_filter = Window.partitionBy("part", F.expr("substr(filter_order, step, 1)"))
    return counts.withColumn("shapley", F.sum("removed").over(of_filter))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``replay`` of the flags of ``docs``."""
    return replay(flags(docs), labels)
