"""Stupid-backoff language-model scores of a corpus over itself, computed relationally.

For ORDER words a word scores ln(c(its n-gram) / c(the n-gram's context)) with the longest
n-gram that occurs at least SEEN times, plus ln BACKOFF for each order it backs off, and
ln(c(word) / all words) plus ORDER - 1 of them if no pair does; a document's score is the mean
over its words.  The first words follow start marks, whose count is that of documents with
words.  SEEN prunes the model: every scored n-gram occurs, so that one occurrence says nothing.

1. Texts are tokenised once, into blocks of some BLOCK words, which are written: word hashes,
   the words' places in them, and the ids.
2. Every block's distinct n-grams of all orders, with their counts, are dealt to buckets by hash:
   one packed row for each bucket.  A frequent n-gram is one entry of a block, however often
   it occurs there, so no key crowds a bucket.
3. A bucket's rows are a partition of the count table and, at once, what is to be joined to it:
   counts are summed by n-gram and each block's n-grams get their totals, one packed row a block.
4. Totals meet their blocks, which sum the scores of their documents.

N-grams are told apart by hashes of as many bits (LEAST_BITS to 64) as leave one of 2 ** SPARE
n-grams to meet another: some one in a million, at any size up to some 10 TB of text.

Defined cases: texts without words (null, empty) have 0 words and a null score; repeated rows
count as often as they stand there and score alike; ids may be null and of any type; very long
texts stay whole in one block, which grows with them; empty tables give no rows; columns but
the id and the text take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, materialise

ORDER, SEEN, BACKOFF = 3, 2, 0.4
#: Words of a block, and n-grams that a bucket gets at most, about.
BLOCK, BUCKET = 1 << 20, 1 << 21
LEAST_BITS, SPARE = 52, 20
#: What stands between words, which are runs of digits, letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of words of each text, distinct words, the place of each word in them)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), BETWEEN)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = pc.dictionary_encode(parts.flatten())
    at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # before a first separator or behind a last one
        own = at != empty
        at, of = at[own], of[own]
    return np.bincount(of, minlength=len(texts)), words, at


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) rows to blocks."""
    import xxhash
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    place: dict[str, int] = {}
    hashes: list[int] = []
    ids: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    words: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        n, w = np.concatenate(sizes), np.concatenate(words)
        own = pa.concat_arrays(ids)
        listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        binary = [pa.array([x], pa.binary()) for x in (pack(n), pack(w), np.array(hashes, np.uint64).tobytes())]
        numbers = [pa.array([x], pa.int64()) for x in ((task << 32) + made, len(w), int((n > 0).sum()))]
        return pa.RecordBatch.from_arrays([*numbers, listed, *binary], names=["block", "total", "starts", "ids", "sizes", "words", "hashes"])

    for batch in blocks(batches, "text"):
        n, known, at = tokens(batch.column(1))
        to = np.zeros(len(known), np.int64)
        for k, w in enumerate(known.to_pylist()):
            found = place.get(w)
            if found is None:
                found = place[w] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(w.encode(), 42))
            to[k] = found
        ids.append(batch.column(0))
        sizes.append(n)
        words.append(to[at])
        held += len(at)
        if held >= BLOCK:
            yield flush()
            made, held = made + 1, 0
            place, hashes, ids, sizes, words = {}, [], [], [], []
    if ids:
        yield flush()


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(sizes: np.ndarray, words: np.ndarray, hashes: np.ndarray, order: int, width: int) -> np.ndarray:
    """Hashes of ``width`` bits (order x words) of the n-grams that end at each word; start marks stand before texts."""
    sizes = sizes[sizes > 0]
    front = order - 1
    at = np.arange(len(words)) + np.repeat(front * np.arange(1, len(sizes) + 1), sizes)
    one = np.zeros(len(words) + front * len(sizes), np.uint64)
    one[at] = hashes[words]
    last, out = one, [_mix(one[at])]
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), last[:-1]])
        last = _mix(before * np.uint64(0x9E3779B97F4A7C15) + one + np.uint64(n))
        out.append(last[at])
    return np.stack(out) >> np.uint64(64 - width)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """``pack`` undone."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack(row["sizes"]).astype(np.int64), unpack(row["words"]).astype(np.int64), np.frombuffer(row["hashes"], np.uint64)


def _deal(bits: int, order: int, width: int):
    """Blocks to rows of their distinct n-grams, one for each bucket (the highest ``bits`` of the hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, n = np.unique(grams(*_loaded(row), order, width), return_counts=True)
                bucket = (found >> np.uint64(width - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(cuts, [*cuts[1:], len(found)]):
                    packed = pack(np.diff(found[i:j], prepend=np.uint64(0))), pack(n[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i])]), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in packed)], names=["bucket", "block", "grams", "n"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their buckets: counts are summed, and each block's n-grams get the sums."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        parts = [np.cumsum(unpack(r["grams"]), dtype=np.uint64) for r in held]
        found, at = np.unique(np.concatenate(parts), return_inverse=True)
        # Counts are exact in doubles below 2**53.
        total = np.bincount(at, np.concatenate([unpack(r["n"]) for r in held]).astype(np.float64), len(found)).astype(np.uint64)[at]
        ends = np.cumsum([len(p) for p in parts])
        packed = [pack(x) for x in np.split(total, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r["block"] for r in held]), pa.array([now] * len(held), pa.int64()), pa.array(packed, pa.binary())], names=["block", "bucket", "totals"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if held:
                    yield flush()
                now, held = row["bucket"], []
            held.append(row)
    if held:
        yield flush()


def word_scores(count: np.ndarray, sizes: np.ndarray, total: int, starts: int) -> np.ndarray:
    """Scores of a block's words by the counts (order x words) of the n-grams that end at them."""
    order = len(count)
    log = np.log(count.astype(np.float64))
    out = log[0] - math.log(max(1, total)) + (order - 1) * math.log(BACKOFF)
    sizes = sizes[sizes > 0]
    first = np.cumsum(sizes) - sizes
    for n in range(2, order + 1):
        context = np.concatenate([[0.0], log[n - 2][:-1]])
        context[first] = math.log(max(1, starts))  # start marks alone
        out = np.where(count[n - 1] >= SEEN, log[n - 1] - context + (order - n) * math.log(BACKOFF), out)
    return out


def _scores(order: int, width: int, total: int, starts: int):
    """Blocks, each followed by its rows of totals, to (id, n_words, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, totals = None, None, []

        def flush() -> pa.RecordBatch:
            sizes, words, hashes = block
            if len(words):
                _, at = np.unique(grams(sizes, words, hashes, order, width), return_inverse=True)
                count = np.concatenate(totals)[at.reshape(order, -1)]
                own = sizes > 0
                ends = np.cumsum(sizes[own], dtype=np.int64)
                sums = np.add.reduceat(word_scores(count, sizes, total, starts), ends - sizes[own])
                mean = np.full(len(sizes), np.nan)
                mean[own] = sums / sizes[own]
            else:
                mean = np.full(len(sizes), np.nan)
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(mean, mask=sizes == 0)], names=["id", "n_words", "score"])

        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                if row["kind"] == 0:
                    if block is not None:
                        yield flush()
                    block, ids, totals = _loaded(row), batch.column("ids")[k].values, []
                else:
                    totals.append(unpack(row["totals"]))
        if block is not None:
            yield flush()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, score) of every document; scores are means of natural logarithms."""
    kind = docs.schema[id_col].dataType
    fields = [("block", T.LongType()), ("total", T.LongType()), ("starts", T.LongType()), ("ids", T.ArrayType(kind)), ("sizes", T.BinaryType()), ("words", T.BinaryType()), ("hashes", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    made = materialise(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_tokenise, schema), "lm-blocks")
    total, starts = made.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("starts"), F.lit(0))).first()
    bits = max(4, math.ceil(math.log2(max(1, total * order / BUCKET))))
    width = min(64, max(LEAST_BITS, math.ceil(math.log2(max(1, total * order))) + SPARE))
    dealt = made.select("block", "sizes", "words", "hashes").mapInArrow(_deal(bits, order, width), "bucket long, block long, grams binary, n binary")
    totals = dealt.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_total, "block long, bucket long, totals binary")
    first = made.select("block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("bucket"), "ids", "sizes", "words", "hashes", F.lit(None).cast("binary").alias("totals"))
    none = {n: F.lit(None).cast(first.schema[n].dataType) for n in ("ids", "sizes", "words", "hashes")}
    then = totals.select("block", F.lit(1).alias("kind"), "bucket", *[c.alias(n) for n, c in none.items()], "totals")
    met = first.unionByName(then).repartition("block").sortWithinPartitions("block", "kind", "bucket")
    out = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    return met.mapInArrow(_scores(order, width, total, starts), out).withColumnRenamed("id", id_col)
