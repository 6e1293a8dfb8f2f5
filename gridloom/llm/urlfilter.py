"""URL rules by Bloom filter cascades, in DataFrame functions only.

Level 1 encodes the listed keys; the keys of the corpus that pass it wrongly go into level 2,
the listed keys that pass level 2 wrongly into level 3, and so on until no level passes a key
wrongly.  Over that key universe the cascade then answers membership exactly, with no join.
A key of an url is one of its host's suffixes and a prefix of its path; an allow cascade and a
block cascade give the verdict of the longest listed key.

The filters are literals of the plan.  Level 1 has LEVEL_BITS + log2(keys of the corpus / keys
listed) bits a listed key, so that about 2**-LEVEL_BITS * listed keys of the corpus pass wrongly,
however large it is; their size is thus bounded by the rule list, which is checked (MOST_RULES).

Defined cases: a null url, or one without ``://``, has empty host and path; no rule fits an
empty host; with no rules at all every verdict is the default; repeated rows are judged each;
other columns pass, but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_BITS = 4
#: Rules of a list: the filters stay under 1 MB.
MOST_RULES = 100_000
MOST_LEVELS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url, both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def keys(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """All (suffix of host) || (prefix of path) with a listed number of labels and path length, longest first.

    Only listed numbers make suffixes: the work is linear in the host, however many labels it has.
    """
    own = F.split(host, r"\.", -1)
    n = F.size(own)
    suffixes = F.array(*[F.when(n >= k, F.array_join(F.slice(own, -k, k), ".")) for k in labels]).cast("array<string>")
    starts = F.array(*[F.when(F.length(path) >= x, F.substring(path, 1, x)) for x in lengths]).cast("array<string>")
    there = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(there(suffixes), lambda s: F.transform(there(starts), lambda p: F.concat(s, p))))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_sort(pairs, lambda a, b: F.length(b) - F.length(a)))


class Level:
    """One Bloom filter: 32-bit words as a literal, probed at ``hashes`` places."""

    def __init__(self, words: list[int], bits: int, hashes: int, seed: int):
        self.words, self.bits, self.hashes, self.seed = words, bits, hashes, seed

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words])
        hit = lambda p: F.getbit(F.element_at(words, (F.floor(p / 32) + 1).cast("int")), (p % 32).cast("int")) == 1
        out = F.lit(True)
        for p in self.places(key):
            out = out & hit(p)
        return out


def _level(items: DataFrame, n: int, bits_a_key: float, seed: int) -> Level:
    """A filter over the column ``key``: words are or-ed together by an aggregation."""
    bits = max(64, math.ceil(n * bits_a_key))
    level = Level([], bits, max(1, round(bits_a_key * math.log(2))), seed)
    places = items.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))
    words = places.groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(bit).alias("b"))
    level.words = [0] * (bits // 32 + 1)
    for row in words.collect():
        level.words[row["w"]] = row["b"]
    return level


class Cascade:
    """Levels that together answer membership exactly over the universe they were built on."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """In the set if an odd number of levels pass before the first that does not."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def cascade(listed: DataFrame, universe: DataFrame, universe_size: int) -> Cascade:
    """Build over ``listed`` (key) and ``universe`` (key; repeats allowed, listed keys too).

    Joins serve the building only, and only on keys that passed level 1.
    """
    listed = listed.select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    if n > MOST_RULES:
        raise ValueError(f"{n} listed keys; a cascade holds at most {MOST_RULES}")
    first = 1.44 * (LEVEL_BITS + max(0.0, math.log2(max(1, universe_size) / n)))
    levels = [_level(listed, n, first, 0)]
    # Few keys: those that level 1 lets pass by mistake.
    wrong = universe.select("key").where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti").persist()
    inside, outside = listed.persist(), wrong
    sets = [outside, inside]  # level 2 encodes outside and is tested with inside
    while (count := sets[0].count()) and len(levels) < MOST_LEVELS:
        levels.append(_level(sets[0], count, 3.0, len(levels)))
        passed = sets[1].where(levels[-1].passes(F.col("key")))
        sets = [passed, sets[0]]
    inside.unpersist()
    outside.unpersist()
    if count:
        raise ValueError("the cascade did not close")
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict; ``rules`` are (verdict, host, path)."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    lengths = sorted({len(p) for _, _, p in rules})
    of = keys(F.col("host"), F.col("path"), lengths, sorted({h.count(".") + 1 for _, h, _ in rules}))
    most = pages.count()
    universe = pages.select(F.explode(of).alias("key"))
    both = {}
    for verdict in ("allow", "block"):
        listed = F.array(*[F.lit(h + p) for v, h, p in rules if v == verdict]).cast("array<string>")
        both[verdict] = cascade(spark.range(1).select(F.explode(listed).alias("key")), universe, most * max(1, len(lengths)) * 4)
    found = F.filter(of, lambda k: both["allow"].contains(k) | both["block"].contains(k))
    rule = F.try_element_at(found, F.lit(1))
    out = pages.withColumn("rule", rule)
    said = F.when(F.col("rule").isNull(), default).when(both["block"].contains(F.col("rule")), "block").otherwise("allow")
    return out.withColumn("verdict", said)
