"""Near-duplicate removal: SimHash and MinHash candidates, exact Jaccard verification, one text a group.

Two texts are near-duplicates if the sets of their runs of WORDS words have a Jaccard
similarity of SIMILARITY or more; groups are the transitive closure, and of each group the
document with the smallest id stays.  Fingerprints for the candidate search are taken over the
set of a text's words: an edit that touches one word changes five runs, but one word, so that
near-duplicates differ in few bits, while unrelated texts stay apart.  Where the difference is one
block of new words, word sets differ as much as run sets do, in more bits than DISTANCE: at
SIMILARITY 9.4 are expected.  Those texts meet by MinHash bands over the runs: two texts share
one of BANDS bands of ROWS minima with probability 1 - (1 - J^ROWS)^BANDS, 0.9994 at 0.8.
Candidates are the components of the generalised-pigeonhole links and the shared bands; their
texts are fetched and compared in their component.  MinHash signatures there only order the work
and skip pairs whose
estimate is far (over six standard errors) below the threshold; sets decide.

Components of over MEMBERS texts are split into blocks whose pairs are tasks of their own.

Defined cases: null texts count as empty, and empty texts are copies of each other; texts of
fewer words than a run are one run; rows that repeat id and text leave one; ids may be null
(kept last); empty tables give no rows; all columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, materialise, with_fields
from .components import components
from .simhash import fingerprints, links, shingle_hashes

WORDS, SIMILARITY, DISTANCE = 5, 0.8, 8
#: Texts of a component that one task compares.
MEMBERS = 1_024
SIGNATURE = 128
_ODD = np.random.default_rng(0).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
#: Bands of a text's MinHash candidates, and the minima that each joins.
BANDS, ROWS = 40, 8
_DRAW = np.random.default_rng(1)
_FLIP, _TIMES, _WEIGHT = (_DRAW.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(3))


def _signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each multiplicative hash over the set."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 2048):
        out = np.minimum(out, ((hashes[i : i + 2048, None] * _ODD) >> np.uint64(32)).min(0, initial=0xFFFFFFFF).astype(np.uint32))
    return out


def bands(hashes: list[int]) -> np.ndarray:
    """A key for each band of minima over the set of run hashes; none for an empty set."""
    if not hashes:
        return np.zeros(0, np.int64)
    x = np.array(hashes, np.uint64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), 128):
        least = np.minimum(least, ((x[i : i + 128, None] ^ _FLIP) * _TIMES).min(0))
    least = (least ^ (least >> np.uint64(32))) * _WEIGHT
    key = (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return key.view(np.int64)


def _band_keys(docs: DataFrame) -> DataFrame:
    """Add ``bands``, the keys of each whole text's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            column = batch.column(batch.schema.get_field_index("text"))
            found = [bands(shingle_hashes(s.as_py(), WORDS, True)) for s in column]
            yield append(batch, {"bands": pa.array(found, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, with_fields(docs, [("bands", T.ArrayType(T.LongType()))]))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal keys of (key, node), in order, to the run's first node."""
    key, first = None, None
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.concatenate([[key is None or keys[0] != key], np.diff(keys) != 0])
        at = np.cumsum(new) - 1
        heads = nodes[new]
        head = np.where(at < 0, nodes[0] if first is None else first, heads[at] if len(heads) else first)
        key, first = keys[-1], head[-1]
        link = nodes != head
        if link.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[link]), pa.array(head[link])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component, size, text) to the sorted set of run hashes."""
    for batch in blocks(batches, "text"):
        found = [np.unique(np.array(shingle_hashes(s.as_py(), WORDS, True), np.uint64)).tobytes() for s in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["node", "component", "size", "runs"])


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of sets with a Jaccard similarity of ``least`` connect."""
    signatures = np.stack([_signature(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    sure = least - 6 * np.sqrt(least * (1 - least) / SIGNATURE)
    out = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[(small >= least * large) & (label[rest] != label[i])]
        if not len(rest):
            continue
        near = (signatures[rest] == signatures[i]).mean(1)
        for j in rest[near >= sure][np.argsort(-near[near >= sure], kind="stable")]:
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= least * (sizes[i] + sizes[j] - both):
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, {}

    def flush() -> pa.RecordBatch:
        nodes = list(held)
        found = similar([held[n] for n in nodes], SIMILARITY) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        at = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        for row, now in enumerate(at):
            if now != key:
                if held:
                    yield flush()
                key, held = now, {}
            held[batch.column(3)[row].as_py()] = np.frombuffer(batch.column(4)[row].as_py(), np.uint64)
    if held:
        yield flush()


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, id, keep) of every row of ``docs``; node tells rows apart by id and text.

    ``keep`` is true for one node of each group of near-duplicates.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", node("id", "text"))
    copy = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    marked = _band_keys(fingerprints(rows.withColumn("copy", copy), words=1, distinct=True)).drop("text")
    rows = materialise(marked, "near-fingerprints")
    first = lambda: F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    texts = rows.groupBy("copy").agg(first().alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    texts = materialise(texts.select("fp", "bands", "first", F.col("first.node").alias("node")), "near-texts")
    near = components(links(texts.select("fp").distinct(), DISTANCE)).withColumnRenamed("node", "fp")
    linked = materialise(texts.join(near, "fp", "left").select("node", F.coalesce("component", "fp").alias("near")), "near-linked")
    heads = linked.groupBy("near").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = materialise(heads.select("near", "head"), "near-heads")
    met = texts.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    edges = met.mapInArrow(_stars, "a long, b long").unionByName(linked.join(heads, "near").select(F.col("node").alias("a"), F.col("head").alias("b")))
    placed = materialise(components(edges), "near-placed")
    # Written, so that the join below is between plain exchanges: a crowded component is split.
    sizes = materialise(placed.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    members = materialise(placed.join(sizes, "component").select("node", "component", "size"), "near-members")
    # Only the components' members are fetched.
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), node(F.col(id_col), F.coalesce(F.col(text), F.lit(""))).alias("node"))
    sets = source.join(members, "node").select("node", "component", "size", "text").mapInArrow(_sets, "node long, component long, size long, runs binary")
    parts = F.ceil(F.col("size") / (MEMBERS // 2)).cast("long")
    zero = F.lit(0).cast("long")
    own = F.when(F.col("size") > MEMBERS, F.pmod(F.xxhash64("node"), parts)).otherwise(zero)
    others = F.when(F.col("size") > MEMBERS, F.sequence(zero, parts - 1)).otherwise(F.array(zero))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "runs")
    verified = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(_compare, "a long, b long")
    joined = components(verified)
    least = texts.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    kept = least.select(F.col("first.node").alias("node"), F.lit(True).alias("keep"))
    return rows.select("node", "id").join(kept, "node", "left").select("node", "id", F.coalesce("keep", F.lit(False)).alias("keep"))


def node(id_col, text):
    """Tells rows apart by id and text."""
    return F.xxhash64(id_col, text)


def drop(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates; same columns."""
    found = materialise(groups(docs, id_col, text), "near-groups")
    kept = found.where("keep").select(F.col("node").alias("_gl_node")).distinct()
    marked = docs.withColumn("_gl_node", node(F.col(id_col), F.coalesce(F.col(text), F.lit(""))))
    repeated = found.where("keep").groupBy(F.col("node").alias("_gl_node")).count().where("count > 1").select("_gl_node")
    out = marked.join(kept, "_gl_node", "left_semi")
    if repeated.limit(1).count():  # rows that repeat id and text leave one
        once = out.join(repeated, "_gl_node", "left_semi").dropDuplicates(["_gl_node"])
        out = out.join(repeated, "_gl_node", "left_anti").unionByName(once)
    return out.select(docs.columns)


