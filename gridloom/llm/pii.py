"""Personal data and information-theoretic sanitisation.

Four patterns find protected entities.  Co-occurrence over the whole corpus then says how strongly
a term reveals one.  Evidence is distinct texts, so that neither copies nor a passage that a text
repeats add any: a text counts once for a term that stands within CONTEXT words of the entity, and
once for one that stands elsewhere in it.  Of a term's counts n, j are near the entity, and its
disclosure is the pointwise mutual information log2((j / n) / P(a count is near the entity)).
Terms near entities are spans too if that exceeds BITS, and the lower bound of the Wilson interval
of j / n PROBABILITY, for one entity or for all of them together: rare words that never stand
elsewhere pass from 4 distinct texts on, frequent ones only if most counts are near.  A word that
stands beside an entity in fewer texts is left: any word that occurs once would be such a one.
``sanitise`` generalises entities to their kind and removes disclosing terms.

Not texts, but the packed terms of each are shuffled to find the distinct ones, with map-side
combining; counts are pre-aggregated in each
task, then summed by term and entity; terms near entities meet their scores in a join.  Nothing
that grows with the corpus is broadcast or collected.

Defined cases: null texts count as empty; rows are told apart by id and text, and repeated
rows get equal results and count once; ids may be null; very long texts are taken whole, in one
pass; a word as near to two entities belongs to the first; words inside entities are no terms;
empty tables give no rows; other columns pass ``sanitise``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, materialise, with_fields

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity.
CONTEXT = 4
#: Bits of disclosure, and probability of an entity nearby (at 95 % confidence), at least.
BITS, PROBABILITY, DEVIATES = 4.0, 0.5, 1.96
WORDS = re.compile(r"[^\W\d_]{3,}")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # within a run of digits no later start can match
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_NEAR = T.StructType([T.StructField("term", T.StringType()), T.StructField("entity", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_NEAR_ARROW = pa.list_(pa.struct([("term", pa.string()), ("entity", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def luhn(digits: str) -> bool:
    """Whether the digits pass the checksum."""
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards: linear in any text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        own = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if own else None
        if found:
            yield at - own, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def entities(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) in code points, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # A part of over three digits is at most 255 only with leading zeros.
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def near(text: str, found: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int, int, int]], list[str]]:
    """(term, entity, start, end) within CONTEXT words of an entity, and the words inside entities.

    Each occurrence counts once, for its nearest entity by words; words are those of the whole text.
    """
    import xxhash

    words = [m.span() for m in WORDS.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    # Words that overlap an entity: inside or across its border.
    taken = {k for _, a, b in found for k in range(bisect_right(ends, a), bisect_left(starts, b))}
    best: dict[int, tuple[int, int]] = {}
    for at, (_, a, b) in enumerate(found):
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        for apart in range(CONTEXT):
            for k in (before - 1 - apart, after + apart):
                if 0 <= k < len(words) and k not in taken and best.get(k, (CONTEXT, 0))[0] > apart:
                    best[k] = (apart, at)
    name = [xxhash.xxh64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass"), 42) - (1 << 63) for _, a, b in found]
    return [(text[starts[k] : ends[k]].lower(), name[at], starts[k], ends[k]) for k, (_, at) in sorted(best.items())], [text[starts[k] : ends[k]].lower() for k in sorted(taken)]


def row_key(id_col: str, text: str) -> Column:
    """Tells rows apart by id and text."""
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit(1), text, id_col).alias("b"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``entities`` and ``near`` (terms in the context of entities) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            spans, terms = [], []
            for s in batch.column(batch.schema.get_field_index(text)):
                s = s.as_py() or ""
                found = entities(s)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                close = near(s, found)[0] if found else []
                terms.append([{"term": t, "entity": e, "start": a, "end": b} for t, e, a, b in close])
            yield append(batch, {"entities": pa.array(spans, _SPAN_ARROW), "near": pa.array(terms, _NEAR_ARROW)})

    return docs.mapInArrow(run, with_fields(docs, [("entities", T.ArrayType(_SPAN)), ("near", T.ArrayType(_NEAR))]))


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, entity, n, j) over distinct texts, told apart by what counts of them and 128 bits of the text.

    Without entity: n counts of a term, near any entity or elsewhere, j of them near one.  With it:
    j texts that hold the term near that entity.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        press = zstandard.ZstdCompressor(level=6, write_content_size=True)
        for batch in blocks(batches, text):
            out = []
            for s in batch.column(0):
                if s.is_valid:
                    elsewhere, pairs = places(s.as_py())
                    said = " ".join(sorted(elsewhere)) + "\n" + " ".join(f"{t} {e}" for t, e in sorted(pairs))
                    out.append(xxhash.xxh3_128_digest(s.as_buffer()) + press.compress(said.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        apart: Counter = Counter()
        close: Counter = Counter()
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                elsewhere, _, pairs = unpress.decompress(packed[16:]).decode("utf-8", "surrogatepass").partition("\n")
                apart.update(elsewhere.split())
                if pairs:
                    flat = pairs.split()
                    close.update((t, int(e)) for t, e in zip(flat[::2], flat[1::2]))
                    close.update((t, None) for t in set(flat[::2]))
                if len(apart) + len(close) > 200_000:
                    yield _counted(apart, close)
                    apart, close = Counter(), Counter()
        yield _counted(apart, close)

    own = docs.select(text).mapInArrow(pack, "packed binary").distinct()
    return own.mapInArrow(count, "term string, entity long, n long, j long").groupBy("term", "entity").agg(F.sum("n").alias("n"), F.sum("j").alias("j"))


def places(text: str) -> tuple[set[str], set[tuple[str, int]]]:
    """A text's terms that stand away from all entities, and (term, entity) pairs that stand near; a term may be both."""
    found = entities(text)
    if not found:
        return {w.lower() for w in set(WORDS.findall(text))}, set()
    close, inside = near(text, found)
    left = Counter(w.lower() for w in WORDS.findall(text))
    left.subtract(inside)
    left.subtract(t for t, *_ in close)
    return {t for t, n in left.items() if n > 0}, {(t, e) for t, e, *_ in close}


def _counted(apart: Counter, close: Counter) -> pa.RecordBatch:
    terms = [*apart, *(t for t, _ in close)]
    entity = [None] * len(apart) + [e for _, e in close]
    n = [*apart.values(), *(c if e is None else 0 for (_, e), c in close.items())]
    j = [0] * len(apart) + list(close.values())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(entity, pa.int64()), pa.array(n, pa.int64()), pa.array(j, pa.int64())], names=["term", "entity", "n", "j"])


def _sure(j: Column, n: Column) -> Column:
    """The lower bound of the Wilson interval of j / n."""
    z2 = F.lit(DEVIATES * DEVIATES)
    p = j / n
    return (p + z2 / (2 * n) - F.lit(DEVIATES) * F.sqrt(F.greatest(p * (1 - p) / n + z2 / (4 * n * n), F.lit(0.0)))) / (1 + z2 / n)


def disclosing(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, disclosure): terms that exceed the thresholds, for one entity or for all together."""
    known = materialise(evidence(docs, text), "evidence")
    terms, pairs = known.where("entity IS NULL"), known.where("entity IS NOT NULL")
    sums = terms.agg(F.sum("n").alias("n"), F.sum("j").alias("j")).first()
    total, nearby = sums["n"] or 1, sums["j"] or 1
    # The bound of j of j is j / (j + z^2): fewer counts cannot pass, however rare the term.
    least = math.ceil(PROBABILITY * DEVIATES**2 / (1 - PROBABILITY))
    of = pairs.groupBy("entity").agg(F.sum("j").alias("e"))
    one = pairs.where(F.col("j") >= least).drop("n").join(of, "entity").join(terms.select("term", "n"), "term").select("term", "n", "j", "e")
    every = terms.where(F.col("j") >= least).select("term", "n", "j", F.lit(nearby).cast("long").alias("e"))
    met = one.unionByName(every).where(_sure(F.col("j"), F.col("n")) >= PROBABILITY)
    bits = F.log2((F.col("j") / F.col("n")) / (F.col("e") / F.lit(total)))
    return met.select("term", bits.alias("disclosure")).where(F.col("disclosure") >= BITS).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, entities, spans): base spans, and all spans with disclosing terms, in order."""
    docs = docs.select(id_col, text).withColumn("key", row_key(id_col, text))
    scanned = materialise(scan(docs, text).drop(text), "entities")
    risky = disclosing(docs, text)
    terms = scanned.dropDuplicates(["key"]).select("key", F.explode("near").alias("x")).select("key", F.col("x.term").alias("term"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    hit = terms.join(risky.select("term"), "term").groupBy("key").agg(F.collect_list(F.struct(F.lit(TERM).alias("kind"), "start", "end")).alias("terms"))
    none = F.array().cast(hit.schema["terms"].dataType)
    order = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = F.array_sort(F.transform(F.concat("entities", F.coalesce("terms", none)), place))
    return scanned.join(hit, "key", "left").select(id_col, "key", "entities", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of each kind, the digest of the base spans, and all spans as a string."""
    kinds = F.transform("entities", lambda s: s["kind"])
    counts = {f"n_{k}": (F.size("entities") - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS}
    return found.withColumns({**counts, "base_sha256": F.sha2(written(F.col("entities")).cast("binary"), 256), "spans": written(F.col("spans"))})


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with entities generalised to [KIND] and disclosing terms removed; same columns."""
    found = find(docs, id_col, text).where(F.size("spans") > 0).dropDuplicates(["key"]).select(F.col("key").alias("_gl_key"), F.col("spans").alias("_gl_spans"))
    met = docs.withColumn("_gl_key", row_key(id_col, text)).join(found, "_gl_key", "left").drop("_gl_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            out = []
            spans = batch.column(batch.schema.get_field_index("_gl_spans"))
            for row, s in enumerate(batch.column(batch.schema.get_field_index(text))):
                s = s.as_py()
                out.append(generalise(s, [(x["kind"], x["start"], x["end"]) for x in spans[row].as_py()]) if spans[row].is_valid and s else s)
            yield append(batch, {text: pa.array(out, pa.string())}).select(names)

    names = [c for c in docs.columns if c != text] + [text]
    return met.mapInArrow(run, T.StructType([docs.schema[n] for n in names])).select(docs.columns)


def generalise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one, under the first's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], "" if kind == TERM else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
