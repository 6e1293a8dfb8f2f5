"""Benchmark decontamination with a generalised suffix automaton.

The automaton recognises every run of words of every normalised test item.  A document's
words are streamed through it while the length of the longest match that ends at each word is
tracked: where it reaches the window length, the last WINDOW words are inside an item, and
states tell which items.  An item shorter than the window is one window by itself.

The automaton is built from the items (deduplicated) in shards of at most SHARD_WORDS words;
each shard is a bounded broadcast.  With several, each shard has tasks of its own, which hold one
automaton and yield rows only for texts that are hit; these are brought together by text.

Defined cases: null documents and items have no words; items without words are never hit; an
item without an id hits words, but is not listed; a repeated item text counts for each of its
ids; rows are independent; very long texts are taken whole; ids of documents are not used; empty
tables work; other columns pass, but for the ones named in ``scan``, which are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, materialise, with_fields

WINDOW = 10
#: Words of the items in one automaton: some 100 MB in a worker at most.
SHARD_WORDS = 200_000
#: On UTF-8, after lower-casing A-Z: bytes of other characters all belong to words.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return WORDS.findall(text.encode().lower()) if text else []


class Automaton:
    """States of the items' suffix automaton, with the items that end a window there."""

    def __init__(self, items: list[tuple[list[bytes], frozenset]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        self.ids = [ids for _, ids in items]
        whole: dict[int, int] = {}  # state of a short item's last word, to the item
        for k, (words, _) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w, ends)
                ends[last].add(k)
            if 0 < len(words) < window:
                whole[last] = k
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:
            # Only states that hold runs of exactly ``window`` words need their items.
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                ends[self.link[s]] |= ends[s]
        #: For a state: its ancestor (or itself) that holds the runs of ``window`` words.
        self.at_window = [-1] * len(self.link)
        #: For a state: short items that are suffixes of its runs, as (words, item), from short to long.
        self.short: list[tuple] = [()] * len(self.link)
        for s in reversed(order):
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.short[s] = self.short[up]
            if s in whole:
                k = whole[s]
                self.short[s] = (*self.short[up], (len(items[k][0]), k))
        keep = set(self.at_window)
        self.found = {s: tuple(ends[s]) for s in keep if s >= 0}
        self.vocabulary = set().union(*self.next) if items else set()

    def _extend(self, last: int, w: bytes, ends: list[set[int]]) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, known, w, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, ends)
        return new

    def _split(self, p: int, q: int, w: bytes, ends: list[set[int]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        self.link[copy], self.link[q] = self.link[q], copy
        ends[copy] = set()
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, out: dict[bytes, int], ends: list[set[int]]) -> int:
        self.next.append(out)
        self.link.append(-1)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the numbers of the items found."""
        step, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        runs: list[list[int]] = []
        items: set[int] = set()
        state = held = 0
        if self.vocabulary.isdisjoint(words):
            return [], items
        start = step[0]
        for i, w in enumerate(words):
            to = step[state].get(w)
            if to is None:
                if w not in start:
                    state = held = 0
                    continue
                while to is None:
                    state = link[state]
                    held = length[state]
                    to = step[state].get(w)
            state = to
            held += 1
            reach = 0
            if held >= window:
                reach = window
                items.update(self.found[self.at_window[state]])
            if short[state]:
                for n, k in short[state]:
                    if n <= held:
                        items.add(k)
                        reach = max(reach, n)
            if reach:
                a = i + 1 - reach
                while runs and a <= runs[-1][0]:
                    runs.pop()
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = i + 1
                else:
                    runs.append([a, i + 1])
        return [(a, b) for a, b in runs], items


def _shards(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[list[bytes], frozenset]]]:
    """Items in lists of at most SHARD_WORDS words, streamed to the driver shard by shard."""
    rows = items.where(F.col(text).isNotNull()).groupBy(text).agg(F.collect_set(F.col(item_id).cast("string")).alias("ids"))
    held: dict[tuple, set] = {}
    size = 0
    for r in rows.sort(text).toLocalIterator():
        words = tuple(words_of(r[0]))
        if not words:
            continue
        if words not in held:
            if held and size + len(words) > SHARD_WORDS:
                yield [(list(w), frozenset(i)) for w, i in held.items()]
                held, size = {}, 0
            held[words] = set()
            size += len(words)
        held[words].update(r["ids"])
    yield [(list(w), frozenset(i)) for w, i in held.items()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FIELDS = [
    ("n_words", T.LongType()),
    ("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ("hit_items", T.ArrayType(T.StringType())),
]


def _scanner(shard, text: str, sparse: bool):
    """Adds the columns of ``scan``; with ``sparse`` only texts that are hit come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shard.value)
        for batch in blocks(batches, text):
            counts, spans, ids = [], [], []
            for s in batch.column(batch.schema.get_field_index(text)):
                words = words_of(s.as_py())
                runs, found = automaton.scan(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in runs])
                ids.append(sorted(set().union(*(automaton.ids[k] for k in found))))
            out = append(batch, {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, _SPANS), "hit_items": pa.array(ids, pa.list_(pa.string()))})
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if sparse else out

    return run


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add n_words, hit_spans (word numbers [start, end), maximal) and hit_items (sorted)."""
    sc = docs.sparkSession.sparkContext
    shards = _shards(items, item_id, item_text)
    first = next(shards)
    second = next(shards, None)
    if second is None:
        return docs.mapInArrow(_scanner(sc.broadcast(first), text, False), with_fields(docs, _FIELDS))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    texts, hits = docs.select(F.col(text)), None
    for shard in itertools.chain([first, second], shards):
        own = texts.mapInArrow(_scanner(sc.broadcast(shard), text, True), with_fields(texts, _FIELDS))
        own = own.select(key.alias("_gl_key"), "hit_spans", "hit_items").dropDuplicates(["_gl_key"])
        hits = own if hits is None else hits.unionByName(own)
    # One row a shard and text at most.
    gathered = materialise(hits.groupBy("_gl_key").agg(F.flatten(F.collect_list("hit_spans")).alias("_gl_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("_gl_items")), "hits")
    met = docs.withColumn("_gl_key", key).join(gathered, "_gl_key", "left").drop("_gl_key")
    names = [c for c in docs.columns if c not in {n for n, _ in _FIELDS}]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in (text, "_gl_spans", "_gl_items")}
            counts = [len(words_of(s.as_py())) for s in at[text]]
            spans = [[{"start": a, "end": b} for a, b in join_runs([(x["start"], x["end"]) for x in s.as_py() or []])] for s in at["_gl_spans"]]
            ids = [s.as_py() or [] for s in at["_gl_items"]]
            yield append(batch.select(names), {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, _SPANS), "hit_items": pa.array(ids, pa.list_(pa.string()))})

    return met.mapInArrow(close, with_fields(docs, _FIELDS))


def join_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(scanned: DataFrame, text: str = "text", longest: float = 1.0) -> DataFrame:
    """Take hit words (with what stands between them) out of ``text``; drop the scan's columns.

    A text whose hit words exceed the share ``longest`` is emptied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            out = []
            spans = batch.column(batch.schema.get_field_index("hit_spans"))
            for row, s in enumerate(batch.column(batch.schema.get_field_index(text))):
                s, hit = s.as_py(), spans[row].as_py()
                if not hit:
                    out.append(s)
                    continue
                data = s.encode()
                places = np.array([m.span() for m in WORDS.finditer(data.lower())])
                if sum(x["end"] - x["start"] for x in hit) > longest * len(places):
                    out.append("")
                    continue
                kept, at = [], 0
                for x in hit:
                    kept.append(data[at : places[x["start"]][0]])
                    at = places[x["end"] - 1][1]
                out.append(b"".join([*kept, data[at:]]).decode())
            yield append(batch, {text: pa.array(out, pa.string())}).select(names)

    names = [c for c in docs_columns(scanned) if c != text] + [text]
    schema = T.StructType([scanned.schema[n] for n in names])
    return scanned.mapInArrow(run, schema).select(docs_columns(scanned))


def docs_columns(scanned: DataFrame) -> list[str]:
    """The columns that were there before ``scan``."""
    return [c for c in scanned.columns if c not in ("n_words", "hit_spans", "hit_items")]


def digests(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of scanned rows."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return scanned.withColumns(
        {
            "n_hit": hit,
            "n_items": F.size("hit_items").cast("long"),
            "items_sha256": F.sha2(F.array_join("hit_items", ",").cast("binary"), 256),
        }
    ).withColumn("contaminated", F.col("n_hit") > 0)


