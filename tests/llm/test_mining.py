"""Filter audits, near-duplicate vectors and collocations against brute force."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import collocations, filteraudit, pqdedup

AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(rows, labels):
    """The same counts by loops."""
    of = {}
    for i, text, part in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        marks = {k: any(x[0] == i and i is not None and x[n] == 1 for x in labels) for n, k in ((1, "good"), (2, "toxic"))}
        of.setdefault(part or "", []).append(({k for k, v in fails.items() if v}, marks))
    out = {}
    for part, docs in of.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for s, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                before = [d for d in docs if letter in d[0] and not any(d is x for x in left)]
                left = [d for d in left if letter not in d[0]]
                shapley[letter] += len(gone)
                out[part, order, s] = [len(left), len(gone), len(before), sum(d[0] == {letter} for d in docs), sum(d[1]["good"] for d in gone), sum(d[1]["toxic"] for d in gone)]
        for (p, order, s), row in out.items():
            if p == part:
                row.append(shapley[order[s - 1]])
    return out


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long, "en"), (2, long, "de"), (2, long, "en"), (3, None, None), (4, "", ""), (5, "AB c", "en"), (6, "a\x0bb\x0cc\x1fd #", "en"), (7, "x " * 50_000, "de"), (None, long, "en"), (8, long + " $", "en"), (9, "É É", "de"), (9, "É É", "de"), (10, "\U0001f600A" + "b" * 8, "en"), (11, "\U0001f600A" + "b" * 9, "en")]
    labels = [(1, 1, 0), (2, 0, None), (2, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, fails int, part string, good string")
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, key string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[k] for k in AUDIT] for r in filteraudit.audit(docs, marks).collect()}
    assert got == audited(rows, labels) and len(got) == 600 * 3
    assert filteraudit.audit(docs.limit(0), marks).count() == 0
    none = filteraudit.audit(docs, marks.limit(0))
    assert none.where("good_lost + toxic_lost > 0").count() == 0 and none.count() == len(got)


def test_audit_is_native(spark, sf_dir):
    from gridloom.llm.queries import op11_filteraudit

    plan = op11_filteraudit(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def linked(vectors, least=0.9):
    """Numbers of links and components by all pairs."""
    ok = {i for i, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    wide = max((len(v) for _, v in vectors if v), default=0)
    unit = {i: pqdedup.unit(np.array([vectors[i][1] + [0.0] * (wide - len(vectors[i][1]))], np.float64))[0] for i in ok}
    near = {i: [j for j in ok if j != i and unit[i] @ unit[j] >= least] for i in ok}
    out = []
    for i, (key, _) in enumerate(vectors):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = min((vectors[j][0] for j in seen if vectors[j][0] is not None), default=None)
        out.append((key, len(near.get(i, [])), component, key is not None and key == component))
    return out


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def _near(spark, vectors, kind="float"):
    df = spark.createDataFrame([(i, v, 7, "s") for i, v in vectors], f"vec_id long, embedding array<{kind}>, node int, kept string")
    found = pqdedup.near_duplicates(df)
    assert found.columns == ["vec_id", "embedding", "node", "n_links", "component_id", "kept"]
    return _ordered((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found.collect())


def _clouds(seed, n, width, copies):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    x = [b * rng.uniform(0.1, 9) + rng.normal(size=width) * s for b in base for s in rng.uniform(0, 0.6, copies) * np.linalg.norm(b) / width**0.5]
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rng.permutation(np.array(x)))]


def test_vectors_of_defined_cases(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(5, one), (3, one), (3, one), (None, one), (8, None), (9, [0.0, 0.0]), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [float("inf")]), (13, []), (14, [1.0, 0.0]), (15, [-1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (16, [3e38, 0.0, 1e38]), (17, [1e-40, 0.0, 0.0])]
    assert _near(spark, rows) == _ordered(linked(rows))
    assert _near(spark, [(1, [1e300, 1e300]), (2, [2e300, 2e300]), (3, [1.0, -1.0])], "double") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert _near(spark, []) == [] and _near(spark, [(1, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("block", [65_536, 40])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pqdedup, "BLOCK", block)
    vectors = _clouds(3, 60, 16, 8) + [(1000 + i, _clouds(4, 1, 16, 1)[0][1]) for i in range(300)]
    got, want = _near(spark, vectors), _ordered(linked(vectors))
    missed = sum(w[1] - g[1] for g, w in zip(got, want))
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and missed <= 0.02 * sum(w[1] for w in want)
    if not missed:
        assert got == want


def test_recall_and_probes_of_the_index(spark, sf_dir):
    """On vectors without structure, partners at the least cosine are found though few lists are visited."""
    rng = np.random.default_rng(1)
    x = pqdedup.unit(rng.normal(size=(8_000, 64)))
    index = pqdedup.learn(x, 40_000, 0.9)
    q = pqdedup.unit(rng.normal(size=(2_000, 64)))
    across = rng.normal(size=q.shape)
    across -= (across * q).sum(1, keepdims=True) * q
    c = 0.9 * q + (1 - 0.81) ** 0.5 * pqdedup.unit(across)
    s, t = q @ index.centroids.T, c @ index.centroids.T
    at, own, theirs = np.arange(len(q)), s.argmax(1), t.argmax(1)
    hit = (s[at, theirs] >= s[at, own] - index.gap) | (t[at, own] >= t[at, theirs] - index.gap)
    probes = (s >= s[at, own][:, None] - index.gap).sum(1)
    assert hit.mean() >= 0.97 and probes.mean() < 0.5 * len(index.centroids)
    # The filter by codes loses no partner.
    codes, error = index.codes(c - index.centroids[theirs])
    apart = np.array([index.distances((q[i] - index.centroids[theirs[i]])[None], codes[i][None])[0, 0] for i in range(200)])
    assert (np.sqrt(apart) <= 0.2**0.5 + error[:200] + 1e-4).all()


@given(st.lists(st.binary(min_size=6, max_size=6), max_size=60))
@settings(deadline=None, max_examples=50)
def test_radix_sort(keys):
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
    got, n = collocations.counted(rows, np.ones(len(rows), np.int64))
    want = sorted(set(keys))
    assert [bytes(r) for r in got] == want and n.tolist() == [keys.count(k) for k in want]


def mined(rows, least, top):
    """The same phrases by dictionaries."""
    f, n = {}, {}
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        data = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = (lang, *words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    f = {k: v for k, v in f.items() if v >= least}
    found = []
    for (lang, *g), a in f.items():
        if len(g) < 2:
            continue
        longer = [v for (o, *h), v in f.items() if o == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * v >= 80 * a for v in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[(lang, *g[:k])] + f[(lang, *g[k:])]), k, f[(lang, *g[:k])], f[(lang, *g[k:])]) for k in range(1, len(g)))
        found.append((lang, -score, -a, b" ".join(g), l, r))
    out, rank = [], {}
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] = rank.get(lang, 0) + 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def _mine(spark, rows, **given_):
    df = spark.createDataFrame([(t, lang, 1, "x", "y") for t, lang in rows], "text string, lang string, n int, part string, phrase string").repartition(3)
    return sorted(tuple(r) for r in collocations.mine(df, **given_).collect())


def _texts(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array(["a", "B", "bb", "c", "Éa", "d-d", "word", "ß", "zz", "\x00q", "z z", "𝄞"])
    ends = np.array([" ", " ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "  "])
    p = 1 / np.arange(1, len(words) + 1)
    return ["".join(w + e for w, e in zip(rng.choice(words, 40, p=p / p.sum()), rng.choice(ends, 40))) for _ in range(n)]


@pytest.mark.parametrize("block,chunk", [(1 << 20, 1 << 21), (150, 100)])
def test_collocations(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = [(t, ["en", "de", None][i % 3]) for i, t in enumerate(_texts(5, 90))] + [(None, "en"), ("", "xx"), (None, None), ("long text of words, " * 5_000, "fr"), ("one two three four five", "en")]
    assert _mine(spark, rows, least=12, top=40) == mined(rows, 12, 40)
    assert _mine(spark, rows, least=3, top=7) == mined(rows, 3, 7)


def test_collocations_of_nothing(spark):
    assert _mine(spark, []) == [] and _mine(spark, [("rare words only", "en")]) == []
