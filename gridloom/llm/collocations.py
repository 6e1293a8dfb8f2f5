"""Collocations: phrases of up to four words whose words stand together more often than apart.

1. Texts are tokenised once, into blocks of some BLOCK words of one part (language): the block's
   distinct words with their counts, and the text as numbers of these words.
2. Words of ``least`` occurrences or more in their part get dense ids, one id for each part and
   word; no phrase with a rarer word can be a candidate, so such words break pieces as marks do.
   Ids meet the blocks in a join of distinct words, never of occurrences.
3. Each place of a block gives one key, the ids of the four words from there on, zeros beyond its
   piece: big-endian ids of one fixed width.  A key's beginnings are the phrases of two, three and
   four words that start there, so one sorted order counts all three lengths.  Blocks sort and
   count their own keys first.
4. Keys are dealt by range; each task radix-sorts them (two bytes a pass, stable) in chunks and
   counts runs of equal beginnings.  Runs at a task's ends may go on in its neighbour: their
   counts are summed afterwards, so that a crowded key may lie in several ranges.
5. Phrases are cut, their parts' counts joined, the lowest score kept; phrases that a longer
   candidate covers go; each part's best are ranked.

Counting is exact; scores are decimals divided exactly.  Everything but the dictionary's ids is
the same however rows are partitioned.

Defined cases: null texts are empty; null parts are ``und``; rows count as often as they are
repeated; ids take no part and need not exist; a very long text stays whole in one block, which
grows with it; no words or an empty table give no rows; phrases with equal score and count are
ranked by their bytes; other columns take no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks as cut
from .common import materialise

#: Words of a block.
BLOCK = 1 << 20
#: Rows that are sorted at once, and rows of a range.
CHUNK = 1 << 21
MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, tabs to blanks, marks to line ends.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + MARKS, bytes(range(97, 123)) + b" " + b"\n" * len(MARKS))
TOKEN = re.compile(rb"[^ \n]+|\n")


class _Block:
    """Words of one part: numbers by first appearance; 0 is the end of a piece."""

    def __init__(self):
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[b"\n"] = 0
        self.seqs: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        known = self.known
        seq = [known[t] for t in TOKEN.findall(text.translate(PLAIN))]
        seq.append(0)
        self.seqs.append(np.array(seq, np.int32))
        return len(seq)

    def row(self) -> tuple[list[str], list[int], bytes]:
        seq = np.concatenate(self.seqs)
        counts = np.bincount(seq, minlength=len(self.known))
        return [w.decode() for w in self.known][1:], counts[1:].tolist(), seq.tobytes()


def tokenised(docs: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(block, part, words, counts, seq): ``seq`` has a number for each word, from 1, and 0 between pieces."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held: dict[str, _Block] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name, block in held.items():
                words, counts, seq = block.row()
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([name]), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([seq], pa.binary())], names=["block", "part", "words", "counts", "seq"])
                made += 1

        for batch in cut(batches, "t"):
            for name, t in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                if name not in held:
                    held[name] = _Block()
                size += held[name].add(t.as_py().encode())
                if size >= most:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    rows = docs.select(F.coalesce(part, F.lit("und")).alias("part"), F.coalesce(text, F.lit("")).alias("t"))
    return rows.mapInArrow(run, "block long, part string, words array<string>, counts array<long>, seq binary")


def dictionary(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Frequent rows of (part, word, f) with a dense ``id`` from 1, and how many there are."""
    placed = materialise(words.where(F.col("f") >= least).withColumn("at", F.monotonically_increasing_id()), "dictionary")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each task that wrote: as many as there are partitions, summed in order.
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    given = placed.withColumn("file", F.shiftright("at", 33)).join(F.broadcast(before), "file")
    ids = given.select("part", "word", "f", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id"))
    return ids, placed.count()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of rows of bytes: least significant two bytes first (numpy sorts 16 bits by radix)."""
    if keys.shape[1] % 2:
        keys = np.concatenate([np.zeros((len(keys), 1), np.uint8), keys], 1)
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for d in range(digits.shape[1] - 1, -1, -1):
        order = order[np.argsort(digits[order, d], kind="stable")]
    return order


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(keys):
        return np.zeros(0, int)
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their ``n``."""
    order = radix_order(keys)
    keys, n = keys[order], n[order]
    at = run_starts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def packed(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of four big-endian ids: at each place with two words or more, those from there on."""
    a = ids
    columns = [a]
    for k in range(1, 4):
        nxt = np.zeros_like(ids)
        nxt[:-k] = ids[k:]
        a = np.where(a > 0, nxt, 0)
        columns.append(a)
    rows = np.stack(columns, 1)[columns[1] > 0]
    return rows.astype(">u8").view(np.uint8).reshape(len(rows), 4, 8)[:, :, 8 - width :].reshape(len(rows), 4 * width)


def _batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    wide = keys.shape[1]
    offsets = pa.py_buffer(np.arange(0, (len(keys) + 1) * wide, wide, dtype=np.int32))
    binary = pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(np.ascontiguousarray(keys))])
    return pa.RecordBatch.from_arrays([binary, pa.array(n, pa.int64())], names=["key", "n"])


def _batches(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 16):
        yield _batch(keys[i : i + (1 << 16)], n[i : i + (1 << 16)])


def _rows(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    """The keys of a batch as rows of bytes."""
    keys = batch.column(0)
    at = np.frombuffer(keys.buffers()[1], np.int32, batch.num_rows + 1, keys.offset * 4)
    return np.frombuffer(keys.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, wide)


def windows(blocks: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(key, n): the four-word keys of all places, counted within some blocks."""
    local = blocks.select("block", "part", F.posexplode("words").alias("pos", "word"))
    found = local.join(ids, ["part", "word"]).select("block", "pos", "id", F.lit(None).cast("binary").alias("seq"))
    texts = blocks.select("block", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("id"), "seq")
    # A block's ids come before its text.
    met = found.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("pos").asc_nulls_last())
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[np.ndarray, np.ndarray]] = []
        keys, size = [], 0
        for batch in batches:
            pos, seqs = batch.column(1), batch.column(3)
            ends = np.flatnonzero(pos.is_null().to_numpy(zero_copy_only=False))
            at = 0
            for end in [*ends.tolist(), batch.num_rows]:
                names.append((pos.slice(at, end - at).to_numpy(zero_copy_only=False), batch.column(2).slice(at, end - at).to_numpy(zero_copy_only=False)))
                at = end + 1
                if end == batch.num_rows:
                    break
                seq = np.frombuffer(seqs[end].as_py(), np.int32)
                of = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
                for p, i in names:
                    of[p.astype(np.int64) + 1] = i
                names = []
                own = packed(of[seq], width)
                keys.append(own)
                size += len(own)
                if size >= most:
                    yield from _batches(*counted(np.concatenate(keys), np.ones(size, np.int64)))
                    keys, size = [], 0
        if size:
            yield from _batches(*counted(np.concatenate(keys), np.ones(size, np.int64)))

    return met.mapInArrow(run, "key binary, n long")


def phrases(keys: DataFrame, width: int, least: int) -> DataFrame:
    """(key, f): beginnings of 2, 3 and 4 ids of the keys with ``least`` occurrences or more."""
    wide, most = 4 * width, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((0, wide), np.uint8), np.zeros(0, np.int64)
        new, sizes, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([held, *new]), np.concatenate([n, *sizes]))

        for batch in batches:
            if not batch.num_rows:
                continue
            new.append(_rows(batch, wide).copy())
            sizes.append(batch.column(1).to_numpy().copy())
            size += batch.num_rows
            if size >= most:
                held, n = merged()
                new, sizes, size = [], [], 0
        held, n = merged()
        if not len(held):
            return
        for k in (2, 3, 4):
            begun = held[:, : k * width]
            at = run_starts(begun)
            sums = np.add.reduceat(n, at)
            keep = sums >= least
            keep[[0, -1]] = True  # these runs may go on in another range
            keep &= begun[at][:, (k - 1) * width :].any(1)
            yield from _batches(begun[at[keep]], sums[keep])

    parts = max(1, -(-keys.count() // CHUNK))
    runs = keys.repartitionByRange(parts, "key").mapInArrow(run, "key binary, n long")
    return runs.groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def ranked(found: DataFrame, ids: DataFrame, totals: DataFrame, width: int, top: int) -> DataFrame:
    """The best phrases of each part with their counts and scores, decoded."""
    w = F.lit(width)
    key = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    # Written: the sides of the joins are then shuffled as they are, so that Spark can split crowded keys.
    counts = materialise(found.select("key", "f", F.lit(None).cast("string").alias("part")).unionByName(ids.select(key.alias("key"), "f", "part")), "phrase-counts")
    length = (F.length("key") / w).cast("int")
    candidates = counts.where(length > 1).select("key", F.col("f").alias("a"), length.alias("k"))
    cuts = candidates.select("key", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.withColumns({"left": F.substring("key", F.lit(1), F.col("j") * w), "right": F.substring("key", F.col("j") * w + 1, (F.col("k") - F.col("j")) * w)})
    side = lambda name, f: counts.select(F.col("key").alias(name), F.col("f").alias(f))
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l"), "part"), "left").join(side("right", "r"), "right")
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.groupBy("key", "a", "k").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("best"), F.max("part").alias("part"))
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for m in (2, 3) for s in range(5 - m)])
    inner = candidates.where("k > 2").select("key", "a", "k", F.explode(spans).alias("in")).where("in.s + in.m <= k AND in.m < k")
    covers = inner.groupBy(F.substring("key", F.col("in.s") * w + 1, F.col("in.m") * w).alias("key")).agg(F.max("a").alias("cover"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(covers, "key", "left").where(F.col("cover").isNull() | (exact("cover") * 100 < exact("a") * 80))
    order = [F.desc("best.score"), F.desc("a")]
    best = kept.select("*", F.rank().over(Window.partitionBy("part").orderBy(*order)).alias("near")).where(F.col("near") <= top)
    best = materialise(best.select("key", "part", "a", "k", "best"), "phrase-best")
    places = best.select("key", F.posexplode(F.sequence(F.lit(0), F.col("k") - 1)).alias("place", "p"))
    places = places.select("key", "place", F.conv(F.hex(F.substring("key", F.col("p") * w + 1, w)), 16, 10).cast("long").alias("id"))
    spelled = places.join(ids.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = best.join(spelled, "key").join(totals, "part")
    final = Window.partitionBy("part").orderBy(*order, "phrase")
    out = named.select(F.col("part").alias("lang"), F.row_number().over(final).cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
    return out.where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = 30, top: int = 2_000, text: str = "text", part: str = "lang") -> DataFrame:
    """The ``top`` collocations of each part: lang, rank, phrase, a, l, r, n, score."""
    blocks = materialise(tokenised(docs, text, part), "phrase-blocks")
    words = blocks.select("part", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("part", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    words = materialise(words, "phrase-words")
    totals = words.groupBy("part").agg(F.sum("f").alias("n"))
    given, known = dictionary(words, least)
    ids = materialise(given, "phrase-ids")
    width = max(1, (known.bit_length() + 7) // 8)
    keys = materialise(windows(blocks, ids, width), "phrase-keys")
    return ranked(materialise(phrases(keys, width, least), "phrases"), ids, totals, width, top)
