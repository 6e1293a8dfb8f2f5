"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, filteraudit, langid, lm, mtree, pii, pqdedup, simhash, suffixdedup, toxicity, urlfilter
from .common import bounded, driver_path, held_out, materialise, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    import public_tokenizers

    ranks = driver_path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return bpe.digests(done).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest inner products of every 50th vector against all others."""
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.where(F.col("id") % 50 == 0))


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove from every document the 200-byte strings that also start elsewhere."""
    done = suffixdedup.digests(suffixdedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The rule list of op4: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u
), r(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean stupid-backoff log score of every document's words."""
    scored = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents)
), p AS (
  SELECT doc_id, w, coalesce(lag(w) OVER o, '') AS v, coalesce(lag(w, 2) OVER o, '') AS u FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), docs AS (
  SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM w
), one AS (
  SELECT w, count(*)::DOUBLE AS n FROM w GROUP BY w UNION ALL SELECT '', n FROM docs
), two AS (
  SELECT v, w, count(*)::DOUBLE AS n FROM p GROUP BY v, w UNION ALL SELECT '', '', n FROM docs
), three AS (
  SELECT u, v, w, count(*)::DOUBLE AS n FROM p GROUP BY u, v, w
), s AS (
  SELECT p.doc_id, CASE WHEN three.n >= 2 THEN ln(three.n / c.n) WHEN two.n >= 2 THEN ln(two.n / a.n) + ln(0.4) ELSE ln(b.n / (SELECT count(*) FROM w)) + 2 * ln(0.4) END AS s
  FROM p JOIN three USING (u, v, w) JOIN two ON two.v = p.v AND two.w = p.w JOIN two c ON c.v = p.u AND c.w = p.v JOIN one a ON a.w = p.v JOIN one b ON b.w = p.w
)
SELECT d.doc_id, count(s.s)::BIGINT AS n_words, round(avg(s.s), 4) AS score FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return decontaminate.digests(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fps = materialise(simhash.fingerprints(docs).drop("text"), "fingerprints")
    out = simhash.near_components(fps, 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.digests(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = langid.predict(docs.drop("lang"), langid.learn(docs))
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every order and step of five filters, for each language."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), firsts AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [(len(ws) < 100)::INT, (100 * len(list_distinct(ws)) < 80 * len(ws))::INT,
     (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT,
     regexp_matches(t, '[#$%&*|]')::INT, coalesce((doc_id > first)::INT, 0)] AS fails
  FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), x(i, c) AS (
  VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS slots
  FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i) JOIN x d ON d.i NOT IN (a.i, b.i, c.i)
  JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), m AS (
  SELECT p.*, filter_order, slots,
    CASE WHEN fails[slots[1]] = 1 THEN 1 WHEN fails[slots[2]] = 1 THEN 2 WHEN fails[slots[3]] = 1 THEN 3
      WHEN fails[slots[4]] = 1 THEN 4 WHEN fails[slots[5]] = 1 THEN 5 ELSE 6 END AS first
  FROM p CROSS JOIN o
), s AS (
  SELECT part, filter_order, i AS step, slots[i] AS letter,
    sum(CASE WHEN first > i THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN first = i THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN first < i AND fails[slots[i]] = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails[slots[i]] = 1 AND list_sum(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN first = i THEN n * good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN first = i THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m CROSS JOIN x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s
"""


def op12_pqdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return pqdedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT d, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT d, lang, regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+') AS ps FROM d)
), words AS (
  SELECT d, k, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT d, k, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces)
), four AS (
  SELECT lang, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM words WINDOW o AS (PARTITION BY d, k ORDER BY i)
), g AS (
  SELECT lang, CASE m WHEN 1 THEN w WHEN 2 THEN w || ' ' || x WHEN 3 THEN w || ' ' || x || ' ' || y ELSE w || ' ' || x || ' ' || y || ' ' || z END AS g
  FROM four CROSS JOIN (VALUES (1), (2), (3), (4)) AS m(m)
), f AS (
  SELECT lang, g.g AS h, string_split(g.g, ' ') AS g, count(*) AS f FROM g WHERE g.g IS NOT NULL GROUP BY lang, g.g HAVING count(*) >= 30
), n AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), c AS (
  SELECT lang, g, f AS a FROM f WHERE len(g) > 1
), halves AS (
  SELECT lang, g, a, k, array_to_string(g[1:k], ' ') AS h1, array_to_string(g[k + 1:len(g)], ' ') AS h2 FROM c JOIN (VALUES (1), (2), (3)) AS k(k) ON k < len(g)
), cuts AS (
  SELECT halves.lang, halves.g, a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score
  FROM halves JOIN f x ON x.lang = halves.lang AND x.h = h1 JOIN f y ON y.lang = halves.lang AND y.h = h2
), lowest AS (
  SELECT lang, g, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, g[s:s + m - 1] AS g, max(a) AS cover FROM c JOIN (VALUES (1), (2), (3)) AS s(s) ON TRUE JOIN (VALUES (2), (3)) AS m(m) ON s + m - 1 <= len(g) AND m < len(g) GROUP BY ALL
), kept AS (
  SELECT lowest.lang, array_to_string(lowest.g, ' ') AS phrase, a, l, r, score FROM lowest LEFT JOIN inner_phrases USING (lang, g)
  WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    known = {"op1_bpe": op1_bpe, "op2_mtree": op2_mtree, "op3_suffixdedup": op3_suffixdedup, "op4_urlfilter": op4_urlfilter, "op5_toxicity": op5_toxicity, "op6_pii": op6_pii, "op7_lm": op7_lm, "op8_decontaminate": op8_decontaminate, "op9_simhash": op9_simhash, "op10_langid": op10_langid, "op11_filteraudit": op11_filteraudit, "op12_pqdedup": op12_pqdedup, "op13_collocations": op13_collocations, "pipeline": pipeline}
    return {name: bounded(f) for name, f in known.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op4_urlfilter": OP4_SQL, "op7_lm": OP7_SQL, "op11_filteraudit": OP11_SQL, "op13_collocations": OP13_SQL}
