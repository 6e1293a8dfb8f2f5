"""Exact removal of repeated byte strings by a hash-compared sparse suffix sort.

A string of SPAN bytes counts as repeated if it starts anywhere else in the corpus.  Each such
string picks an anchor inside it, the GRAM-byte substring of least hash, from its content
alone, so equal strings pick equal anchors at equal places.  An anchor stands for the run of
windows that pick it, some SPAN + 64 bytes of context, and anchors are some 65 bytes apart.

1. Anchors are counted by (gram hash, context digest).  Where a context occurs twice, all its
   windows are repeated.  Digests are XXH3 of the bytes and the anchor's place in them, a hash of
   another kind than the gram's: repetitive texts, a weakness of polynomials, don't make both collide.
2. Contexts that differ but share the gram are fetched, and within each gram's group the
   suffixes from the anchor on, and the reversed prefixes before it, are mergesorted.  Prefix
   polynomial hashes and binary search give common extensions, so a comparison takes
   log(SPAN) steps; neighbours' extensions are verified on the bytes.  Windows are equal
   exactly if both of their sides are in the same class of neighbours.
3. Groups of over GROUP contexts are not sorted in one task: 128-bit BLAKE2 digests of their
   windows are counted by Spark instead, whatever their number.

Texts are known by hashes of their content (80 bits), so copies of a text share the work.  What
is gathered of a text (anchors asked for, merged intervals) is at most some times its own size.

Defined cases: null texts count as empty; texts under SPAN bytes keep all; repeated rows are
copies of each other, hence removed where they have SPAN bytes; empty tables give no rows;
other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, materialise, with_fields

SPAN, GRAM = 200, 72
REACH = SPAN - GRAM + 1  # windows that may pick an anchor
#: Contexts of a gram that one task sorts.
GROUP = 4_096
#: Texts that a task remembers as fetched, so that it fetches no copy again.
FETCHED = 1 << 16
#: Bytes of contexts that are sorted together.
BUFFER = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for k, b in enumerate((_BASE, _BACK)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the weak low bits of polynomial hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Prefix polynomial hashes of a byte array: any substring's hash in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def common(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Common extension of the strings at a and b, of at most la and lb bytes, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.minimum(la, lb)
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, place, windows before, windows after) of a text's anchors.

    Windows that pick the anchor at ``place`` start from place - before to place - after.
    """
    n = len(data) - SPAN + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    h = Hashes(data)
    grams = _mix(h.of(np.arange(len(data) - GRAM + 1), GRAM))
    # Least of each window: upper half hash, lower half place, so that ties go left.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: n], least[REACH - width : REACH - width + n])
    picked = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(picked)) + 1])
    last = np.concatenate([first[1:], [n]]) - 1
    place = picked[first]
    size = last - first + SPAN
    whole = data.tobytes()
    context = np.array([_digest(whole[a : a + n] + bytes([p])) for a, n, p in zip(first.tolist(), size.tolist(), (place - first).tolist())], np.uint64)
    return grams[place], context, place, place - first, place - last


_ROW = "gram long, context long, key long, at long"


def _pack(place: np.ndarray, before: np.ndarray, after: np.ndarray, check: int) -> np.ndarray:
    # before <= REACH - 1 = 128, after >= 0.
    return (place << 32) | (before << 24) | (after << 16) | check


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (at >> 32) & 0x7FFFFFFF, (at >> 24) & 255, (at >> 16) & 255, at & 0xFFFF


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """key, check and bytes of each text of (text, key, check)."""
    for s, k, c in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        yield k, c, (s.as_py() or "").encode()


def _anchor_rows(counted: bool):
    """Either (gram, context, n), summed in each block, or each distinct text's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            seen: dict[tuple[int, int], int] = {}
            rows: dict[tuple[int, int], tuple] = {}
            for k, c, data in _texts(batch):
                if len(data) < SPAN:
                    continue
                seen[k, c] = seen.get((k, c), 0) + 1
                if (k, c) not in rows:
                    rows[k, c] = anchors(np.frombuffer(data, np.uint8))
            if not rows:
                continue
            gram, context, place, before, after = (np.concatenate([r[i] for r in rows.values()]) for i in range(5))
            size = [len(r[0]) for r in rows.values()]
            if counted:
                n = np.repeat(list(seen.values()), size)
                order = np.lexsort((context, gram))
                gram, context, n = gram[order], context[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(context) != 0)]))
                yield pa.RecordBatch.from_arrays([_long(gram[first]), _long(context[first]), _long(np.add.reduceat(n, first))], names=["gram", "context", "n"])
            else:
                key = np.repeat(np.array([k for k, _ in rows], np.int64), size)
                check = np.repeat(np.array([c for _, c in rows], np.int64), size)
                yield pa.RecordBatch.from_arrays([_long(gram), _long(context), _long(key), _long(_pack(place, before, after, check))], names=["gram", "context", "key", "at"])

    return run


def mergesort(h: Hashes, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups (contiguous), and each one's common extension with the one before.

    All groups are merged at once, run width by run width; an element finds its place in the
    opposite run by binary search with hash comparisons.
    """
    n = len(start)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    begin, end = begin[of], np.append(begin[1:], n)[of]
    order = np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether x is less than y (or equal, where ties)."""
        k = h.common(start[x], size[x], start[y], size[y])
        ex, ey = k == size[x], k == size[y]
        cx = np.where(ex, -1, h.data[np.minimum(start[x] + k, len(h.data) - 1)].astype(np.int64))
        cy = np.where(ey, -1, h.data[np.minimum(start[y] + k, len(h.data) - 1)].astype(np.int64))
        return (cx < cy) | (ties & (cx == cy))

    width = 1
    while len(at := np.flatnonzero(end - begin > width)):
        local = at - begin[at]
        block = local // (2 * width) * (2 * width)
        left = local - block < width
        other = begin[at] + block + np.where(left, width, 0)
        low = np.minimum(other, end[at])
        high = np.minimum(other + width, end[at])
        base = low.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            smaller = before(order[mid], order[at[open_]], ~left[open_])
            low[open_] = np.where(smaller, mid + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], mid)
        to = begin[at] + block + np.where(left, local - block, local - block - width) + (low - base)
        moved = order.copy()
        moved[to] = order[at]
        order, width = moved, width * 2
    same = np.concatenate([[False], np.diff(group) == 0])
    common = np.full(n, -1)
    x = np.flatnonzero(same)
    common[x] = h.common(start[order[x - 1]], size[order[x - 1]], start[order[x]], size[order[x]])
    return order, common


def _verified(h: Hashes, start: np.ndarray, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether all common extensions hold on the bytes themselves."""
    x = np.flatnonzero(common > 0)
    length = common[x]
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return bool((h.data[np.repeat(start[order[x - 1]], length) + step] == h.data[np.repeat(start[order[x]], length) + step]).all())


def _by_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order and extensions without hashes, should any have collided."""
    texts = [data[a : a + n].tobytes() for a, n in zip(start, size)]
    order = np.array(sorted(range(len(texts)), key=lambda i: (group[i], texts[i])), int)
    common = np.full(len(order), -1)
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        if group[k] == group[k - 1]:
            common[k] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return order, common


def repeated(contexts: list[bytes], before: np.ndarray, after: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Farthest and nearest start before its anchor of each context's repeated windows (-1: none).

    Contexts of a group stand together; one starts ``before`` bytes before its anchor and ends
    SPAN bytes after its last window, which starts ``after`` bytes before the anchor.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    place = np.cumsum(sizes) - sizes + before
    # Right sides as they are; left sides reversed.
    flipped = data[::-1]
    sides = []
    for bytes_, start, size in ((data, place, sizes - before), (flipped, len(data) - place, before)):
        h = Hashes(bytes_)
        order, common = mergesort(h, start, size, group)
        if not _verified(h, start, order, common):
            order, common = _by_bytes(bytes_, start, size, group)
        sides.append((order, common))
    far, near = np.full(len(contexts), -1), np.full(len(contexts), -1)
    for back in range(REACH):  # windows that start ``back`` bytes before the anchor
        valid = np.flatnonzero((before >= back) & (after <= back))
        if len(valid) < 2:
            continue
        label = np.empty((2, len(contexts)), np.int64)
        for k, least in ((0, SPAN - back), (1, back)):
            order, common = sides[k]
            label[k, order] = np.cumsum(common < least)
        both = label[0, valid] * (len(contexts) + 1) + label[1, valid]
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        hit = valid[count[inverse] > 1]
        far[hit] = back
        near[hit] = np.where(near[hit] < 0, back, near[hit])
    return far, near


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of their grams, keys and places to the intervals that their repeated windows cover.

    Copies of a text that several tasks fetched follow each other and count once.
    """
    held: list[tuple] = []
    size, now, last = 0, None, None

    def flush() -> pa.RecordBatch:
        gram, key, at, contexts = zip(*held)
        place, before, after, check = _unpack(np.array(at, np.int64))
        far, near = repeated(list(contexts), before, after, np.array(gram, np.int64))
        hit = far >= 0
        return _intervals(np.array(key, np.int64)[hit], (place - far)[hit], (place - near + SPAN)[hit], check[hit])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] == last:
                continue
            last = row[:3]
            if row[0] != now:
                if size > BUFFER:
                    yield flush()
                    held, size = [], 0
                now = row[0]
            held.append(row)
            size += len(row[3])
    if held:
        yield flush()


_INTERVAL = "key long, a long, b long, check long"


def _intervals(key, a, b, check) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_long(x) for x in (key, a, b, check)], names=["key", "a", "b", "check"])


def _fetch(whole: bool):
    """Contexts of (text, key, check, wanted [gram, at]) rows, or their windows' hashes.

    A task fetches one of a text's copies: the others hold the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in blocks(batches, "text"):
            wanted = batch.column(3)
            for row, (k, c, data) in enumerate(_texts(batch)):
                if (k, c) in seen:
                    continue
                if len(seen) >= FETCHED:
                    seen.clear()
                seen.add((k, c))
                asked = wanted[row].as_py()
                gram = np.array([w["gram"] for w in asked], np.int64)
                at = np.array([w["at"] for w in asked], np.int64)
                own = _unpack(at)[3] == c
                gram, at = gram[own], at[own]
                place, before, after, _ = _unpack(at)
                if whole:
                    cut = [data[i:j] for i, j in zip((place - before).tolist(), (place - after + SPAN).tolist())]
                    yield pa.RecordBatch.from_arrays([_long(gram), _long(np.full(len(at), k)), _long(at), pa.array(cut, pa.binary())], names=["gram", "key", "at", "context"])
                elif len(at):
                    start = np.unique(np.concatenate([np.arange(p - b, p - a + 1) for p, b, a in zip(place, before, after)]))
                    digests = b"".join(hashlib.blake2b(data[i : i + SPAN], digest_size=16).digest() for i in start.tolist())
                    one, two = np.frombuffer(digests, np.uint64).reshape(-1, 2).T.copy()
                    yield pa.RecordBatch.from_arrays([_long(one), _long(two), _long(np.full(len(start), k)), _long(start), _long(np.full(len(start), c))], names=["one", "two", "key", "a", "check"])

    return run


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, check, spans): byte intervals of each distinct text that repeated strings cover."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", *_key("text"))
    long = texts.where(F.octet_length("text") >= SPAN)
    n = F.sum("n").alias("n")
    # Summed in each block, then dealt by gram once: both sums need no further exchange.
    counts = long.mapInArrow(_anchor_rows(True), "gram long, context long, n long").repartition("gram").groupBy("gram", "context").agg(n)
    grams = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("contexts"), F.count_if(F.col("n") == 1).alias("single"))
    known = counts.join(grams.where("total > 1"), "gram").select("gram", "context", "n", "contexts", "single")
    rows = long.mapInArrow(_anchor_rows(False), _ROW).join(known, ["gram", "context"])
    rows = materialise(rows.select("gram", "context", "key", "at", "n", "contexts", "single"), "anchors")
    place, before, after = F.shiftright("at", 32), F.shiftright("at", 24).bitwiseAND(255), F.shiftright("at", 16).bitwiseAND(255)
    check = F.col("at").bitwiseAND(0xFFFF)
    sure = rows.where("n > 1").select("key", (place - before).alias("a"), (place - after + SPAN).alias("b"), check.alias("check"))
    # Contexts seen once, and one of each other context of their gram.
    open_ = rows.where("single > 0 AND contexts > 1 AND n = 1").select("gram", "key", "at", "contexts")
    partner = rows.where("single > 0 AND contexts > 1 AND n > 1").groupBy("gram", "context").agg(F.min(F.struct("key", "at")).alias("x"), F.first("contexts").alias("contexts"))
    asked = open_.unionByName(partner.select("gram", F.col("x.key").alias("key"), F.col("x.at").alias("at"), "contexts"))
    # Written for the same reason as the intervals below: copies crowding a key are split.
    asked = materialise(asked.groupBy("key").agg(F.collect_set(F.struct("gram", "at", "contexts")).alias("wanted")), "asked")
    met = long.join(asked, "key").select("text", "key", "check", "wanted")
    some = lambda test: met.withColumn("wanted", F.filter("wanted", test)).where(F.size("wanted") > 0)
    contexts = some(lambda w: w["contexts"] <= GROUP).mapInArrow(_fetch(True), "gram long, key long, at long, context binary")
    sorted_ = contexts.repartition("gram").sortWithinPartitions("gram", "key", "at").mapInArrow(_resolve, _INTERVAL)
    found = sure.unionByName(sorted_)
    if rows.where(f"single > 0 AND contexts > {GROUP}").limit(1).count():
        windows = some(lambda w: w["contexts"] > GROUP).mapInArrow(_fetch(False), "one long, two long, key long, a long, check long")
        windows = materialise(windows, "windows")
        twice = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
        found = found.unionByName(windows.join(twice, ["one", "two"]).select("key", "a", (F.col("a") + SPAN).alias("b"), "check"))
    ordered = found.repartition("key").sortWithinPartitions("key", "check", "a")
    return ordered.mapInArrow(_merge, "key long, found array<struct<a:long,b:long,check:long>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals in the order of their texts to one row a key: overlapping and touching ones are one."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("check", pa.int64())]))
    keys: list[int] = []
    held: list[list[dict]] = []
    for batch in batches:
        for key, a, b, check in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not keys or keys[-1] != key:
                if len(keys) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, kind)], names=["key", "found"])
                    keys, held = [], []
                keys.append(key)
                held.append([])
            last = held[-1][-1] if held[-1] else None
            if last and last["check"] == check and a <= last["b"]:
                last["b"] = max(last["b"], b)
            else:
                held[-1].append({"a": a, "b": b, "check": check})
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, kind)], names=["key", "found"])


def _key(text: str):
    return F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).bitwiseAND(0xFFFF).alias("check")


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its kept bytes (binary) and add n_bytes and removed (byte intervals)."""
    whole = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    key, check = _key(text)
    # Written, so that the join below is between plain exchanges: copies crowding a key are split.
    found = materialise(find(docs, text).select(F.col("key").alias("_gl_key"), F.col("found").alias("_gl_found")), "intervals")
    met = whole.withColumns({"_gl_key": key, "_gl_check": check}).join(found, "_gl_key", "left")
    names = [c for c in docs.columns if c not in (text, "n_bytes", "removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            at = {c: batch.schema.get_field_index(c) for c in (text, "_gl_check", "_gl_found")}
            kept, sizes, spans = [], [], []
            for s, c, found in zip(batch.column(at[text]), batch.column(at["_gl_check"]), batch.column(at["_gl_found"])):
                data, c = s.as_py().encode(), c.as_py()
                runs: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in (found.as_py() or []) if x["check"] == c):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[i:j] for i, j in list(pairwise(edges))[::2]))
                sizes.append(len(data))
                spans.append([{"a": a, "b": b} for a, b in runs])
            yield append(batch.select(names), {text: pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))})

    interval = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    return met.mapInArrow(run, with_fields(docs.select(names), [(text, T.BinaryType()), ("n_bytes", T.LongType()), ("removed", interval)]))


def digests(removed: DataFrame, text: str = "text") -> DataFrame:
    """n_removed, n_spans and the kept bytes' digest."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return removed.withColumns({"n_removed": total, "n_spans": F.size("removed").cast("long"), "kept_sha256": F.sha2(text, 256)})
