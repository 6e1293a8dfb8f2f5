"""Suffix dedup, SimHash and near-duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import components, neardup, simhash, suffixdedup

DRAW = random.Random(3)
LETTERS = "abcdefghijklmnopqrstuvwxyz     "


def prose(n):
    return "".join(DRAW.choice(LETTERS) for _ in range(n))


def test_suffix_dedup(spark, monkeypatch):
    shared, long = prose(260), prose(900)
    texts = [None, "", "short", prose(199), shared + prose(300), prose(170) + shared, prose(50) + shared[:199] + prose(80), shared[10:250] + "é" * 40, long, long, "ab" * 400, "x" * 500, prose(300) + "\n" + prose(300)]
    edited = [long[:k] + "#" + long[k + 1 :] for k in range(0, 900, 45)]
    texts += edited
    twice = prose(230)
    texts.append(twice + prose(40) + twice)
    df = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, key long, found string")
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for limit in (suffixdedup.GROUP, 3):  # sorted in tasks, and counted by hashes
        monkeypatch.setattr(suffixdedup, "GROUP", limit)
        got = {r["doc_id"]: r for r in suffixdedup.digests(suffixdedup.remove(df)).collect()}
        assert len(got) == len(texts)
        for i, b in enumerate(data):
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - 199):
                if count[b[k : k + 200]] > 1:
                    gone[k : k + 200] = True
            kept = bytes(np.frombuffer(b, np.uint8)[~gone])
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            r = got[i]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i
            assert r["key"] == i and r["found"] == "k"
    assert suffixdedup.remove(df.limit(0)).count() == 0


def test_suffix_dedup_of_a_crowded_partner(spark, monkeypatch):
    text = prose(700)
    near = text[:340] + "#" + text[341:]
    copies = 20_000
    df = spark.createDataFrame([(0, near)], "doc_id long, text string").unionByName(spark.range(1, copies + 1).select("id", F.lit(text)).toDF("doc_id", "text"))
    got = suffixdedup.digests(suffixdedup.remove(df)).groupBy(F.col("doc_id") == 0, "n_removed", "n_spans").count().collect()
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {(True, 699, 2, 1), (False, 700, 1, copies)}
    # A task fetches a copy once, and what several tasks fetched is sorted once.
    place, context, at, before, after = suffixdedup.anchors(np.frombuffer(text.encode(), np.uint8))
    wanted = [{"gram": int(g), "at": int(p)} for g, p in zip(place.view(np.int64), suffixdedup._pack(at, before, after, 7))]
    batch = pa.RecordBatch.from_pylist([{"text": text, "key": 1, "check": 7, "wanted": wanted}] * 500)
    fetched = list(suffixdedup._fetch(True)(iter([batch] * 40)))
    assert sum(b.num_rows for b in fetched) == len(wanted)
    sizes = []
    monkeypatch.setattr(suffixdedup, "repeated", lambda contexts, *_: sizes.append(len(contexts)) or (np.full(len(contexts), -1),) * 2)
    one = fetched[0].sort_by([("gram", "ascending"), ("key", "ascending"), ("at", "ascending")]).to_pylist()
    many = [r for r in one for _ in range(300)]
    list(suffixdedup._resolve(iter([pa.RecordBatch.from_pylist(many)])))
    assert sizes == [len(wanted)]


def test_mergesort_sorts():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 12), dtype=np.uint8)) for _ in range(500)]
    group = np.sort(rng.integers(0, 40, 500))
    size = np.array([len(t) for t in texts])
    data, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    h = suffixdedup.Hashes(data)
    order, common = suffixdedup.mergesort(h, start, size, group)
    assert [(group[i], texts[i]) for i in order] == sorted(zip(group.tolist(), texts))
    other, same = suffixdedup._by_bytes(data, start, size, group)
    assert (common == same).all() and suffixdedup._verified(h, start, order, common)


def reference_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in linked(i):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash(spark, monkeypatch):
    base = [prose(400) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "One", "a b c", "\x1ca \xa0b"] + base + [b.replace("a", "A") for b in base]
    texts += [b + " tail" * k for b in base for k in range(1, 6)] + [base[0]] * 5
    rows = [(i * 3, t, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    want = [reference_fingerprint(t) for t in texts]
    for bucket in (simhash.BUCKET, 4):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        fps = simhash.fingerprints(df).persist()
        for distance in (4, 12):
            got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_components(fps, distance).collect()}
            label = grouped(len(want), lambda i: [j for j in range(i) if (want[i] ^ want[j]).bit_count() <= distance])
            assert got == {i * 3: (want[i], label[i] * 3) for i in range(len(want))}
    empty = simhash.fingerprints(df.limit(0))
    assert simhash.near_components(empty, 4).count() == 0


def test_pigeonhole_thresholds_cover():
    rng = np.random.default_rng(5)
    sample = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for distance in (1, 4, 8):
        for n in (100, 10**6, 10**9):
            plan = simhash.allocate(sample, n, distance)
            assert sum(t + 1 for t in plan.thresholds) == distance + 1
            assert sorted(b for p in plan.parts for b in p) == list(range(64))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 99), (99, 98), (7, 7), (None, 3)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {98: 98, 99: 98, 100: 98}
    assert components.components(df.limit(0)).count() == 0


def jaccard_groups(texts):
    sets = [frozenset(simhash.shingle_hashes(t, 5, True)) for t in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    return grouped(len(texts), lambda i: [j for j in range(i) if near(sets[i], sets[j])])


def test_near_duplicates(spark, monkeypatch):
    words = ["".join(DRAW.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [[DRAW.choice(words) for _ in range(250)] for _ in range(8)]

    def edit(doc, n):
        out = list(doc)
        for _ in range(n):
            out[DRAW.randrange(len(out))] = DRAW.choice(words)
        return out

    texts = [" ".join(d) for b in base for d in [b, b, *[edit(b, n) for n in (1, 2, 3, 5, 8, 20)]]] + [None, "", "", "word", "Word", "long " * 40_000]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(0, texts[0], "x", 0), (None, "nobody", "x", 0), (None, "nobody", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, keep long")
    label = jaccard_groups([t or "" for t in texts])
    want = sorted({label[i] for i in range(len(texts))})
    for members in (neardup.MEMBERS, 4):
        monkeypatch.setattr(neardup, "MEMBERS", members)
        out = neardup.drop(df)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == want
        assert sum(r["doc_id"] is None for r in got) == 1
    assert neardup.drop(df.limit(0)).count() == 0


def test_near_duplicates_that_differ_in_a_block(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = []
    for k in range(90):
        size = draw.randrange(120, 400)
        doc = [draw.choice(words) for _ in range(size)]
        block = [draw.choice(words) for _ in range(round(size * (1 / (0.81 + 0.14 * k / 90) - 1)))]
        texts += [" ".join(doc), " ".join([doc + block, block + doc, doc[len(block) :]][k % 3])]
    label = jaccard_groups(texts)
    want = sorted(set(label))
    assert len(want) < 100  # most pairs reach the threshold
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.drop(df).collect()) == want


def test_bands_meet_at_the_threshold():
    draw = np.random.default_rng(4)
    for shared in (0.8, 0.9):
        missed = 0
        for _ in range(1000):
            runs = draw.integers(0, 1 << 64, 200, dtype=np.uint64)
            missed += not (neardup.bands(runs.tolist()) == neardup.bands(runs[: int(200 * shared)].tolist())).any()
        assert missed <= 4
    apart = [neardup.bands(draw.integers(0, 1 << 64, 200, dtype=np.uint64).tolist()) for _ in range(200)]
    assert len(np.unique(np.concatenate(apart))) == 200 * neardup.BANDS
