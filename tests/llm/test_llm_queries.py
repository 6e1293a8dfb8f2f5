"""The registered queries and the pipeline over the small tables."""

import duckdb
import pytest

from gridloom.llm import queries as Q

KEYS = {
    "op1_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_mtree": ["query_id", "rank", "vec_id", "score"],
    "op3_suffixdedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_urlfilter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_lm": ["doc_id", "n_words", "score"],
    "op8_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_filteraudit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op12_pqdedup": ["vec_id", "n_links", "component_id", "kept"],
    "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.mark.parametrize("name", KEYS)
def test_query(spark, sf_dir, name):
    out = Q.queries()[name](spark, sf_dir)
    assert out.columns == KEYS[name]
    table = {"op2": None, "op4": "pages", "op11": None, "op12": "embeddings", "op13": None}.get(name.split("_")[0], "documents")
    if table:
        assert out.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, sf_dir).select(want.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), "test")
        assert docs.columns == before.columns and docs.schema == before.schema
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] > sizes[0] / 2
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == sizes[-1] and tokens.where("NOT exact OR n_tokens <> size(token_ids)").count() == 0


def test_pipeline_of_defined_cases(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i * i}" for i in range(60)]
    text, other = " ".join(words), " ".join(f"v{i * 3}" for i in range(70))
    rows = [(1, text), (1, text), (4, text), (2, None), (3, ""), (None, other), (5, "long text " * 20_000), (6, " ".join(f"u{i}" for i in range(40)) + " a.b@c.org"), (7, " ".join([*words[:58], "x", "y"]))]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, hit_spans string, size int, node long, fp string, decoded string"
    full = spark.createDataFrame([(i, t, None, "s", len(t or ""), "keep", None, 1, 2, "f", "d") for i, t in rows], names)
    for folder, docs in (("full", full), ("empty", full.limit(0))):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert set(out.columns) == set(full.columns) - {"text"} | {"token_ids", "n_tokens", "exact"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(got, key=lambda i: (i is None, i)) == [1, 2, 5, 6, None] and out.count() == 5
    assert all(r["exact"] and r["score"] == "keep" and r["node"] == 2 and r["fp"] == "f" and r["decoded"] == "d" for r in got.values())
    assert got[2]["n_tokens"] == 0 and got[5]["n_tokens"] > 20_000
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
