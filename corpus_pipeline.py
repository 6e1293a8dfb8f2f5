"""A training corpus from ``documents``: five stages, each one operator of ``gridloom.llm``.

Every stage is written as Parquet and read again as the next one's input.  All stages but the last
return the columns that they get; the last drops ``text`` and adds token_ids, n_tokens and exact
(in place of columns of these names).  n_chars, where it is there, follows changed texts.

Defined cases: a null text stays null up to the last stage, which gives it no tokens; null and
empty texts are copies of each other, so that one document of all of these stays (as of any group
of near-duplicates, the smallest id); null ids stay, last in their group; rows that repeat id and
text leave one; ties in a group cannot occur but between such rows; very long texts are taken
whole; an empty table gives no rows; without labels no document is toxic, without benchmark items
no passage is cut; other columns pass through all stages, also where they have names that a stage
uses on its way (score, hit_spans...), but for the three that the last stage makes.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, neardup, pii, toxicity
from gridloom.llm.common import bounded, driver_path, materialise, table


#: A document with a larger share of its words in benchmark windows is emptied.
MOST_COVERED = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date with a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _free(*names: str):
    """For stages: the stage uses these names; columns of the input that have them are put aside and back."""

    def wrap(stage):
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            aside = {n: f"_kept_{n}" for n in names if n in docs.columns}
            out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
            return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)

        return run

    return wrap


@bounded
@_free("score", "predicted")
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.drop(docs)


@bounded
@_free("n_words", "hit_spans", "hit_items")
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return _counted(decontaminate.remove(found, longest=MOST_COVERED)).select(docs.columns)


@bounded
def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised, disclosing terms are removed."""
    return _counted(pii.sanitise(docs)).select(docs.columns)


@bounded
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token ids, decoded again as a proof of the round trip."""
    import public_tokenizers

    ranks = driver_path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.withColumnsRenamed({"decoded": "_kept_decoded"}), ranks, public_tokenizers.PATTERN)
    back = bpe.decode(ids, ranks).withColumn("exact", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"))
    return back.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text", "decoded").withColumnsRenamed({"_kept_decoded": "decoded"})


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", remove_benchmark),
    ("personal_data", sanitise_personal_data),
    ("tokens", tokenise),
]

#: Trained dictionaries, transitive similarity and BPE are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
