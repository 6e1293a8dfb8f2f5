"""Language identification by rank-order profiles.

A language's profile is the ranking of the PROFILE most frequent 1- to 3-grams of its training
texts; a document's is the ranking of its own.  The out-of-place distance sums how far each of
the document's n-grams is from its rank in a profile (PROFILE if missing); the nearest profile
wins.  N-grams are those of lower-cased words of letters between word marks; equal counts rank
by a hash of the n-gram, the same for documents and profiles.

Profiles are learned from at most SAMPLE texts a language, one an id (ids are chosen by a hash;
of several texts of an id the one of least hash is taken); predictions take whole texts of all
rows.  The driver gets PROFILE rows a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text
if nothing was learned; ties go to the smaller language name; repeated rows are predicted
each and learned from once; rows with a null id are predicted, never learned from (held_out is
null for them); other columns pass, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, held_out, with_fields

GRAMS = (1, 2, 3)
PROFILE = 400
#: Training texts of a language at most.
SAMPLE = 2_000
#: Sampled ids that are broadcast at most; beyond, texts are shuffled to them.
BROADCAST = 1_000_000
REMEMBERED_WORDS, REMEMBERED_GRAMS = 300_000, 1_000_000
WORDS = re.compile(r"[^\W\d_]+")


def grams_of(word: str) -> list[str]:
    """1- to 3-grams of a word between word marks (the mark alone is none)."""
    marked = f"_{word}_"
    return [g for n in GRAMS for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) != "_"]


class _Words(dict):
    """Word to the bytes of its n-grams' numbers; n-grams are numbered as they come."""

    def __init__(self, profiles: dict[str, dict[str, int]] | None = None):
        super().__init__()
        self.names = sorted(profiles or {})
        self.profiles = [profiles[k] for k in self.names] if profiles else []
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.number: dict[str, int] = {}
        self.tie = np.zeros(1024, np.int64)
        self.rank = np.zeros((1024, len(self.names)), np.int32)

    def __missing__(self, word: str) -> bytes:
        ids = []
        for g in grams_of(word):
            k = self.number.get(g)
            if k is None:
                k = self.number[g] = len(self.number)
                if k == len(self.tie):
                    self.tie = np.concatenate([self.tie, np.zeros_like(self.tie)])
                    self.rank = np.concatenate([self.rank, np.zeros_like(self.rank)])
                self.tie[k] = 0xFFFFFFFF - zlib.crc32(g.encode("utf-8", "surrogatepass"))
                self.rank[k] = [p.get(g, -1) for p in self.profiles]
            ids.append(k)
        out = self[word] = np.array(ids, np.int32).tobytes()
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of a text's n-grams."""
        if len(self) > REMEMBERED_WORDS or len(self.number) > REMEMBERED_GRAMS:
            self.reset()
        words = Counter(WORDS.findall(text.lower()))
        parts = list(map(self.__getitem__, words))
        ids = np.frombuffer(b"".join(parts), np.int32)
        weights = np.repeat(np.fromiter(words.values(), np.int64, len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
        if len(ids) < 2000:
            found, at = np.unique(ids, return_inverse=True)
            return found, np.bincount(at, weights, len(found)).astype(np.int64)
        total = np.bincount(ids, weights).astype(np.int64)
        found = np.flatnonzero(total)
        return found, total[found]

    def ranked(self, text: str) -> np.ndarray:
        """Numbers of the most frequent n-grams, in order."""
        found, total = self.counts(text)
        key = (total << 32) | self.tie[found]
        if len(key) > PROFILE:
            top = np.argpartition(-key, PROFILE)[:PROFILE]
            found, key = found[top], key[top]
        return found[np.argsort(-key)]

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest profile's language and how clearly it is nearer than the next."""
        order = self.ranked(text)
        if not len(order):
            return "und", 0.0
        rank = self.rank[order]
        apart = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(order))[:, None])).sum(0)
        best = int(np.argmin(apart))
        rest = np.delete(apart, best)
        second = int(rest.min()) if len(rest) else PROFILE * len(order)
        return self.names[best], float(second / (second + apart[best])) if second else 1.0


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, dict[str, int]]:
    """Language to its profile (n-gram to rank), from rows that are not held out."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col))
    # Ids, not rows, are counted and drawn: repeated rows of an id don't crowd out its language.
    drawn = known.select(id_col, lang).distinct()
    counts = drawn.groupBy(lang).agg(F.count(F.lit(1)).alias("_gl_n"))
    languages = counts.count()
    few = languages * SAMPLE <= BROADCAST
    # The hash falls below the share of 4 * SAMPLE rows: a crowded language is thinned before it meets in a task.
    ids = drawn.withColumn("_gl_h", F.pmod(F.xxhash64(id_col), F.lit(1 << 40)))
    thinned = ids.join(F.broadcast(counts) if few else counts, lang).where(F.col("_gl_h").cast("double") * F.col("_gl_n") < F.lit(4.0 * SAMPLE * (1 << 40)))
    order = Window.partitionBy(lang).orderBy("_gl_h", id_col)
    chosen = thinned.withColumn("_gl_r", F.row_number().over(order)).where(F.col("_gl_r") <= SAMPLE).select(id_col, lang)
    if few:
        chosen = F.broadcast(chosen)  # SAMPLE ids a language at most
    rows = known.select(id_col, F.col(lang), F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).alias("found")).join(chosen, [id_col, lang], "left_semi")
    texts = rows.groupBy(id_col, lang).agg(F.min("found").alias("found")).select(F.col(lang).alias("lang"), "found.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            total: Counter = Counter()
            for name, words in _words_by_language(batch).items():
                for w, n in words.items():
                    for g in grams_of(w):
                        total[name, g] += n
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"]
            )

    counted = texts.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.crc32(F.col("gram").cast("binary")))
    top = counted.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < PROFILE)
    profiles: dict[str, dict[str, int]] = {}
    for r in top.collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return profiles


def _words_by_language(batch: pa.RecordBatch) -> dict[str, Counter]:
    out: dict[str, Counter] = {}
    for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        out.setdefault(name, Counter()).update(WORDS.findall(s.lower()))
    return out


def predict(docs: DataFrame, profiles: dict[str, dict[str, int]], text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, words = regex.compile(r"\p{L}").search, _Words(profiles)
        for batch in blocks(batches, text):
            found = []
            for s in batch.column(batch.schema.get_field_index(text)):
                s = s.as_py()
                found.append(words.predict(s) if profiles and s and letter(s) else ("und", 0.0))
            yield append(batch, {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    return docs.mapInArrow(run, with_fields(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())]))
