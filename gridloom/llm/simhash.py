"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits.  Correlated bits are grouped into partitions; if two fingerprints
differ in at most t bits, then for thresholds with sum(t_i + 1) = t + 1 at least one partition
differs in at most t_i bits.  The thresholds, unequal where that is cheaper, are allocated by
dynamic programming on candidate counts estimated from a bounded sample.  Each fingerprint is
sent to the bucket of each partition's value and probes the values within t_i bits; buckets
verify whole distances and yield spanning links, never all pairs.  Buckets of over BUCKET
rows are split into blocks, and pairs of blocks go to tasks of their own, so no row is lost.

Links join equal fingerprints and those within t bits; components are the transitive closure.

Defined cases: null texts count as empty; texts without words have fingerprint zero, which
links like any other; rows with a null id get a fingerprint and their component, but name no
component (all such: null); repeated rows link to each other; empty tables give no rows; other
columns pass ``fingerprints``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, materialise, with_fields
from .components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Fingerprints from which bit correlations and candidate counts are estimated.
SAMPLE = 1_000
#: Rows of a bucket that one task compares.
BUCKET = 16_384
#: What sending a probe costs, in comparisons of two fingerprints.
PROBE_COST = 500.0


def shingle_hashes(text: str | None, words: int, distinct: bool = False) -> list[int]:
    """XXH64 of every run of ``words`` words (all words, if fewer), repeats included."""
    import xxhash

    found = WORDS.findall(text.encode().lower()) if text else []
    if not found:
        return []
    if distinct:
        found = list(dict.fromkeys(found)) if words == 1 else found
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    line, one = b" ".join(found), xxhash.xxh64_intdigest
    k = min(words, len(found))
    out = [one(line[i : j - 1], SEED) for i, j in zip(starts, ends[k - 1 :])]
    return list(dict.fromkeys(out)) if distinct else out


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):  # sums of up to 4096 fit 16 bits
        part = np.array(hashes[i : i + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.uint16)
    return int(np.packbits(total * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, distinct: bool = False) -> DataFrame:
    """Add ``fp``, the fingerprint (long) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            yield append(batch, {"fp": pa.array([fingerprint(shingle_hashes(s.as_py(), words, distinct)) for s in column], pa.int64())})

    return docs.mapInArrow(run, with_fields(docs, [("fp", T.LongType())]))


class Plan:
    """Partitions of the bits and their thresholds (-1: not used)."""

    def __init__(self, parts: list[list[int]], thresholds: list[int]):
        self.parts, self.thresholds = parts, thresholds

    def values(self, fps: np.ndarray, part: int) -> np.ndarray:
        """The bits of a partition, packed."""
        out = np.zeros(len(fps), np.uint64)
        for k, bit in enumerate(self.parts[part]):
            out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        return out

    def masks(self, part: int) -> np.ndarray:
        """All changes of at most the threshold's number of bits."""
        w = len(self.parts[part])
        found = [sum(1 << b for b in some) for n in range(self.thresholds[part] + 1) for some in itertools.combinations(range(w), n)]
        return np.array(found, np.uint64)


def _partitions(bits: np.ndarray, count: int) -> list[list[int]]:
    """Bits in ``count`` groups of near-equal width, correlated bits together."""
    x = bits - bits.mean(0)
    scale = np.sqrt((x**2).sum(0)) + 1e-9
    near = np.abs(x.T @ x) / np.outer(scale, scale)
    left, parts = set(range(64)), []
    for i in range(count):
        width = 64 // count + (i < 64 % count)
        start = max(left, key=lambda b: (sum(near[b][o] for o in left if o != b), -b))
        part = [start]
        left.remove(start)
        while len(part) < width:
            best = max(left, key=lambda b: (near[b][part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(part)
    return parts


def allocate(sample: np.ndarray, n: int, distance: int) -> Plan:
    """The cheapest partitions and thresholds for ``n`` fingerprints like those of the sample."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best: tuple[float, Plan] | None = None
    for count in range(2 if distance else 1, min(distance + 1, 16) + 1):
        parts = _partitions(bits, count)
        costs = []
        for part in parts:
            own = bits[:, part]
            apart = (own.sum(1)[:, None] + own.sum(1)[None, :] - 2 * own @ own.T)[np.triu_indices(len(sample), 1)]
            near = np.cumsum(np.bincount(np.rint(apart).astype(int), minlength=len(part) + 1)) / pairs
            probes = np.cumsum([comb(len(part), k) for k in range(len(part) + 1)])
            # A uniform floor keeps small samples from promising empty buckets.
            chance = np.maximum(near, probes / 2.0 ** len(part)) if len(sample) > 1 else probes / 2.0 ** len(part)
            costs.append([0.0] + [n * n / 2 * chance[t] + PROBE_COST * n * probes[t] for t in range(min(4, len(part)))])
        # table[s]: least cost with sum(t_i + 1) = s so far.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in table.items():
                for t1, more in enumerate(cost):  # t1 = threshold + 1
                    if s + t1 <= distance + 1 and (s + t1 not in step or c + more < step[s + t1][0]):
                        step[s + t1] = (c + more, [*chosen, t1 - 1])
            table = step
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            best = (table[distance + 1][0], Plan(parts, table[distance + 1][1]))
    return best[1]


def _links(fps: np.ndarray, other: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph within ``fps`` (or between it and ``other``)."""
    both = fps if other is None else np.concatenate([fps, other])
    label = np.arange(len(both))
    found: list[tuple[int, int]] = []
    for i in range(len(fps)):
        near = np.bitwise_count(both[i + 1 if other is None else len(fps) :] ^ fps[i]) <= distance
        if not near.any():
            continue
        js = np.flatnonzero(near) + (i + 1 if other is None else len(fps))
        fresh, first = np.unique(label[js], return_index=True)
        for own, at in zip(fresh, js[first]):
            if own != label[i]:
                found.append((i, at))
                label[label == own] = label[i]
    at = np.array(found, int).reshape(-1, 2)
    return both[at[:, 0]], both[at[:, 1]]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect what the distinct fingerprints ``fp`` within ``distance`` connect."""
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    plan = allocate(sample, n, distance)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_of in range(0, batch.num_rows, 4096):
                x = batch.column(0).slice(part_of, 4096).to_numpy().view(np.uint64)
                for part, t in enumerate(plan.thresholds):
                    if t < 0:
                        continue
                    keys = plan.values(x, part)
                    for mask in plan.masks(part):
                        bucket = (keys ^ mask) | np.uint64(part << 56)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(x.view(np.int64))], names=["bucket", "fp"])

    def verify(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
        for bucket, x, over in runs(batches, most):
            a, b = x[:0], x[:0]
            if over:  # left for the next step, as rows of (bucket, fingerprint)
                a, b = np.full(len(x), bucket, np.int64), x
            elif len(x) > 1:
                part = (bucket >> 56) & 0xFF
                home = plan.values(x, part) == np.uint64(bucket & ((1 << 56) - 1))
                if home.any():
                    a, b = _links(x[home], None, distance)
                    if plan.thresholds[part] > 0 and not home.all():
                        c, d = _links(x[home], x[~home], distance)
                        a, b = np.concatenate([a, c]), np.concatenate([b, d])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    out, zero = "a long, b long, over boolean", F.lit(0).cast("long")
    rows = fps.select("fp").mapInArrow(probe, "bucket long, fp long").select("bucket", zero.alias("i"), zero.alias("j"), "fp")
    met = rows.repartition("bucket").sortWithinPartitions("bucket")
    most = BUCKET
    first = materialise(met.mapInArrow(lambda b: verify(b, most), out), "links")
    found = first.where("NOT over").select("a", "b")
    left = first.where("over").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
    if left.limit(1).count():
        sizes = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (BUCKET // 2)).cast("long").alias("parts"))
        own = left.join(sizes, "bucket").withColumn("o", F.pmod(F.xxhash64("fp"), F.col("parts")))
        pairs = own.withColumn("p", F.explode(F.sequence(zero, F.col("parts") - 1))).select("bucket", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), "fp")
        dealt = pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = found.unionByName(dealt.mapInArrow(lambda b: verify(b, None), out).select("a", "b"))
    return found


def runs(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(bucket, fingerprints, whether over ``most``) of consecutive rows with equal first three columns.

    At most ``most`` rows and a batch are held; a bucket with more comes in pieces, all marked.
    """
    key, held, size, over = None, [], 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in range(3)])
        x = batch.column(3).to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((np.diff(at) != 0).any(0)) + 1).tolist(), len(x)]
        for i, j in itertools.pairwise(cuts):
            now = tuple(at[:, i].tolist())
            if now != key:
                if size:
                    yield key[0], np.concatenate(held), over
                key, held, size, over = now, [], 0, False
            held.append(x[i:j])
            size += j - i
            if most and size > most:
                over = True
                yield key[0], np.concatenate(held), over
                held, size = [], 0
    if size:
        yield key[0], np.concatenate(held), over


def near_components(fps: DataFrame, distance: int, id_col: str = "doc_id") -> DataFrame:
    """Add component_id, the smallest id reachable, to rows with ``fp`` (written, hence stable)."""
    fps = fps.drop("component_id")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    found = components(links(nodes.select("fp"), distance))
    of = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    of = materialise(of, "simhash-components")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(of.join(least, "component").select("fp", "component_id"), "fp")
