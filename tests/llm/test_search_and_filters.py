"""M-tree search and URL filters against brute force."""

import numpy as np
import pytest

from gridloom.llm import mtree, urlfilter


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 256)
    monkeypatch.setattr(mtree, "SHARD", 400)
    monkeypatch.setattr(mtree, "BLOCK", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (1500, 12)).astype(np.float32)
    x[100:400] = x[100]  # a crowd of equal vectors: ties
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(5000, None, "n"), (5001, [float("nan")] * 12, "n"), (5002, [1.0, None] + [0.0] * 10, "n"), (5003, [float("inf")] + [0.0] * 11, "n"), (None, [9.0] * 12, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    v = mtree.integer_vectors(df)
    got = {}
    for r in mtree.top_k(v, v.where("id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert sorted(got) == list(range(0, 1500, 50))
    for q, found in got.items():
        scores = ints @ ints[q]
        order = [int(i) for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:5]
        assert [found[k] for k in range(1, 6)] == [(i, int(scores[i])) for i in order]


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, -1.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<double>")
    v = mtree.integer_vectors(df)
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in mtree.top_k(v, v.where("id % 50 = 0")).collect())
    assert found == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert mtree.top_k(v.limit(0), v.limit(0)).count() == 0
    mixed = mtree.integer_vectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="inner product"):
        mtree.top_k(mixed, mixed)


def test_top_k_bounds_and_parallel_shards(spark, monkeypatch):
    monkeypatch.setattr(mtree, "LEAST", 100)
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 80, (900, 6))).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    got = mtree.top_k(df, df.where("id % 10 = 0").unionByName(df.where("id = 20")), 7)
    plan = {}
    for r in got.collect():
        plan.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 900, 10):
        scores = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(900), -scores)) if i != q][:7]
        assert sorted(plan[q]) == [(k + 1, i, int(scores[i])) for k, i in enumerate(order)]


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain(url, rules=RULES):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, path = rest[:end], rest[end:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "https://Example.COM/en/1?x#y", "https://www.example.com/en/", "http://xexample.com/en/", "http://a.net/es/q", "http://net/es", "http://b.net?/es/", "http://net/fr/#/", "x://y://com/", "http://example.com./en/", "http://..com/", "http://é.com/é", "a://b\n.com/\n", "http://deep.www.example.com/en/x" + "y" * 5000]


def test_url_filter(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    for r in urlfilter.judge(df, RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]), r["url"]
    assert urlfilter.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(df, []).collect()} == {"allow"}


def test_long_hosts(spark):
    host = "a." * 20_000 + "example.com"
    rows = [(1, f"http://{host}/en/x"), (2, f"http://{host}/de/x"), (3, "http://" + "x" * 100_000 + ".net/es/"), (4, "http://" + "." * 5_000 + "/"), (5, "http://www.example.com" + "/en/" * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, RULES).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: ("www.example.com/en/", "allow")}
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "LEVEL_BITS", -4)  # a poor first level: more levels are needed
    listed = spark.range(0, 3000, 10).selectExpr("concat('k', id) AS key")
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    made = urlfilter.cascade(listed, universe, 3000)
    assert len(made.levels) > 2
    hit = {r["key"] for r in universe.where(made.contains(universe["key"])).collect()}
    assert hit == {f"k{i}" for i in range(0, 3000, 10)}
