"""Toxicity, personal data, language models, decontamination and languages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import decontaminate, langid, lm, pii, toxicity
from gridloom.llm.queries import OP7_SQL

DRAW = random.Random(11)
WORDS = ["".join(DRAW.choice("abcdefghij") for _ in range(DRAW.randrange(3, 9))) for _ in range(400)]
BAD = ["vilest", "wretch", "scoundrel", "gormless"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def document(bad):
    words = [DRAW.choice(WORDS) for _ in range(DRAW.randrange(20, 120))]
    for _ in range(bad):
        words[DRAW.randrange(len(words))] = DRAW.choice(BAD)
    return " ".join(words)


def test_toxicity(spark):
    toxic = [int(DRAW.random() < 0.3) for _ in range(1500)]
    rows = [(i, document(4 * t), 0.0) for i, t in enumerate(toxic)]
    docs = spark.createDataFrame([*rows, (9000, None, 1.0), (9001, "", 1.0), (9002, "x " * 30_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, toxic[0]), (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    own = [i for i in range(len(toxic)) if held(i)]
    assert sum(got[i]["predicted"] == toxic[i] for i in own) / len(own) > 0.97
    # Labels of held-out rows are never seen.
    flipped = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    none = toxicity.fit(docs, labels.limit(0))
    assert none is None and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_scores_by_brute_force(spark):
    import zstandard

    toxic = [int(DRAW.random() < 0.3) for _ in range(400)]
    docs = spark.createDataFrame([(i, document(3 * t)) for i, t in enumerate(toxic)] + [(900, ""), (901, None), (902, "Vilest, 12 é!")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))

    def length(window, content):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False).compress(window))

    seen = {}

    def gain(word):
        window = b" " + word + b" " + bytes(range(0x80, 0xA0))
        if word not in seen:
            seen[word] = min(10, length(window, model.ordinary) - length(window, model.toxic))
        return seen[word]

    for r in toxicity.score(docs, model).collect():
        words = re.findall(rb"[a-z\x80-\xff]+", (r["text"] or "").encode().lower())
        reached = [sum(gain(w) >= k for w in words) for k in range(1, 11)]
        n = max(1, len(words))
        x = [math.log(1 + c) for c in reached] + [math.log(1 + 100 * c / n) for c in reached] + [min(c, 1) for c in reached] + [math.log(n)]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_toxicity_fit_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 300)
    toxic = [int(i % 4 == 0) for i in range(400)]
    rows = [(i, document(4 * t)) for i, t in enumerate(toxic)]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    usual = next(i for i, t in enumerate(toxic) if not t and not held(i))
    made = lambda more: toxicity.fit(spark.createDataFrame(more, "doc_id long, text string"), labels)
    want = made(rows)
    for more in (rows * 3, rows + [rows[usual]] * 700):  # every row repeated, and a hot key
        got = made(more)
        assert got is not None and (got.toxic, got.ordinary) == (want.toxic, want.ordinary)
        assert (got.weights == want.weights).all()
    # Several texts of an id are one row of the fit.
    assert made(rows + [(usual, f"other {k}") for k in range(700)]) is not None


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab_%@.-+0123456789() é\n", max_size=80))
def test_entities(text):
    assert pii.entities(text) == base(text)


def test_entities_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "+" + "1 " * 200_000, "a@b" * 100_000):
        pii.entities(text)


def test_pii(spark):
    marked = ["sesame", "tango"]
    rows = []
    for i in range(900):
        words = [DRAW.choice(WORDS) for _ in range(40)]
        if i % 10 == 0:
            words[20:20] = [marked[i // 10 % 2], f"user{i}@mail.example.org", "é" * 3]
        rows.append((i, " ".join(words), "k", "s"))
    rows += [(1900, None, "k", "s"), (1901, "", "k", "s"), (1902, "call +1 (212) 555-0100 now", "k", "s"), (1902, "call +1 (212) 555-0100 now", "k", "s"), (None, "10.0.0.1 or 300.1.1.1", "k", "s"), (1903, "x" * 20_000 + " 4111 1111 1111 1111", "k", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, spans string")
    got = pii.digests(pii.find(df)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, *_ in rows:
        want, r = base(text or ""), by_id[i]
        plain = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        said = r["spans"].split(",") if r["spans"] else []
        assert [s for s in said if not s.startswith("term")] == (plain.split(",") if plain else [])
    terms = [(r["doc_id"], s) for r in got for s in r["spans"].split(",") if s.startswith("term")]
    texts = {i: t for i, t, *_ in rows}
    assert {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for i, s in terms} >= set(marked)
    want = {(i, f"term:{a}:{b}") for i, a, b in disclosed(rows)}
    assert set(terms) == want and len(want) > 90
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    out = {r["doc_id"]: r for r in clean.collect()}
    assert out[1902]["text"] == "call [PHONE] now" and out[1900]["text"] is None and out[1902]["key"] == "k"
    assert "@" not in "".join(r["text"] or "" for r in out.values()) and "sesame" not in out[0]["text"]
    assert pii.find(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


def disclosed(rows):
    """Places of disclosing terms by plain counting."""
    word = re.compile(r"[^\W\d_]{3,}")
    count, pairs, near, places, seen = Counter(), Counter(), Counter(), [], set()
    for i, text, *_ in rows:
        text = text or ""
        new = text not in seen
        seen.add(text)
        beside, away = set(), set()
        spans = base(text)
        words = [m for m in word.finditer(text) if not any(m.start() < b and a < m.end() for _, a, b in spans)]
        every = [m.span() for m in word.finditer(text)]
        for m in words:
            def apart(a, b, m=m):
                return sum(b <= x and y <= m.start() for x, y in every) if m.start() >= b else sum(m.end() <= x and y <= a for x, y in every)

            gaps = [(apart(a, b), k) for k, (_, a, b) in enumerate(spans)]
            if gaps and min(gaps)[0] < 4:
                _, a, b = spans[min(gaps)[1]]
                beside.add((m[0].lower(), text[a:b].lower()))
                places.append((i, m[0].lower(), m.start(), m.end()))
            else:
                away.add(m[0].lower())
        if new:
            pairs.update(beside)
            near.update({t for t, _ in beside})
            count.update([*away, *{t for t, _ in beside}])
    total, z = sum(count.values()), 1.96
    entity = Counter()
    for (t, e), j in pairs.items():
        entity[e] += j
    def passes(j, n, e):
        p = j / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return low >= 0.5 and math.log2(p / (e / total)) >= 4

    bad = {t for (t, e), j in pairs.items() if passes(j, count[t], entity[e])} | {t for t, j in near.items() if passes(j, count[t], sum(near.values()))}
    return [(i, a, b) for i, t, a, b in places if t in bad]


def test_disclosure_is_not_repetition(spark):
    """Copies and repeated passages are no evidence; distinct texts are, from four on."""
    plain = [" ".join(DRAW.choice(WORDS) for _ in range(30)) for _ in range(400)]
    passage = "the quiet harbour ledger jane@mail.example.org keeps every other secret"
    own = [f"{a} zebulon pat@mail.example.org {b}" for a, b in zip(plain[:4], plain[4:8])]
    few = [f"{a} ottoline kim@mail.example.org {b}" for a, b in zip(plain[8:11], plain[11:14])]
    both = [f"{plain[20 + k]} wainscot lou@mail.example.org {plain[30 + k]} wainscot wainscot" for k in range(4)]
    rows = [*enumerate(plain), *[(1000 + k, passage) for k in range(5)], (1100, " and ".join([passage] * 9)), *[(1200 + k, t) for k, t in enumerate(own)], *[(1300 + k, t) for k, t in enumerate(few * 4)], *[(1400 + k, t) for k, t in enumerate(both)]]
    found = pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    texts = dict(rows)
    said = {(r["doc_id"], texts[r["doc_id"]][int(a) : int(b)]) for r in found for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"}
    assert said == {(1200 + k, "zebulon") for k in range(4)}
    assert said == {(i, texts[i][a:b]) for i, a, b in disclosed(rows)}


def test_near_takes_whole_words():
    long = "w" * 300
    text = f"one two {long} confidential a@b.org {'z' * 200} three İstanbul four five"
    terms, inside = pii.near(text, pii.entities(text))
    assert [t for t, *_ in terms] == ["one", "two", long, "confidential", "z" * 200, "three", "İstanbul".lower(), "four"] and inside == ["org"]


def test_generalise_overlaps():
    assert pii.generalise("abcdefgh", [("email", 1, 4), ("card", 2, 6), ("term", 6, 7)]) == "a[EMAIL]h"


def test_lm(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(lm, "BLOCK", 900)
    monkeypatch.setattr(lm, "BUCKET", 300)
    texts = [" ".join(DRAW.choice(WORDS[: 5 + i]) for _ in range(DRAW.randrange(1, 60))) for i in range(150)]
    texts += [None, "", "...", "The the THE", "é É", "solo", "a b " * 5000] + [texts[0]] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in lm.score(df.withColumn("key", df["doc_id"])).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for doc_id, n, score in con.sql(OP7_SQL).fetchall():
        assert got[doc_id]["n_words"] == n
        assert (score is None and got[doc_id]["score"] is None) or math.isclose(got[doc_id]["score"], score, abs_tol=1e-4)
    assert lm.score(df.limit(0)).count() == 0
    for order in (1, 2):  # other orders against counting
        for doc_id, n, score in counted(texts, order):
            r = {r["doc_id"]: r for r in lm.score(df, order=order).collect()}[doc_id] if doc_id == 0 else None
            assert r is None or (r["n_words"] == n and math.isclose(r["score"], score, abs_tol=1e-9))
    # Any type of id, and null ones.
    odd = spark.createDataFrame([("x", "a b", 1), (None, "a b", 2), (None, None, 3)], "id string, body string, score int")
    assert sorted((r["id"] or "", r["n_words"]) for r in lm.score(odd, "id", "body").collect()) == [("", 0), ("", 2), ("x", 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abAÉé9._ \x00\n", max_size=30), min_size=1, max_size=5))
def test_tokens(texts):
    n, known, at = lm.tokens(lm.pa.array(texts, lm.pa.string()))
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)) for t in texts]
    assert n.tolist() == [len(w) for w in words] and [known[k].as_py() for k in at.tolist()] == [w for t in words for w in t]


def counted(texts, order):
    """(number, words, score) of each text by plain counting."""
    padded = [["", ""] + decontaminate_words(t) for t in texts]
    total = sum(len(p) - 2 for p in padded)
    count = Counter(tuple(p[i - n + 1 : i + 1]) for p in padded for i in range(2, len(p)) for n in range(1, order + 1))
    starts = sum(len(p) > 2 for p in padded)
    for k, p in enumerate(padded):
        scores = []
        for i in range(2, len(p)):
            for n in range(order, 0, -1):
                c = count[tuple(p[i - n + 1 : i + 1])]
                if n == 1:
                    scores.append(math.log(c / total) + (order - 1) * math.log(0.4))
                elif c >= 2:
                    context = tuple(p[i - n + 1 : i])
                    scores.append(math.log(c / (count[context] if any(context) else starts)) + (order - n) * math.log(0.4))
                    break
        yield k, len(p) - 2, sum(scores) / len(scores) if scores else None


def decontaminate_words(text):
    return [w.decode() for w in decontaminate.words_of(text)]


def brute(docs, items, window):
    runs = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            runs.setdefault(tuple(w[k : k + window]), set()).update([str(i)] if i is not None else [])
    lengths = sorted({len(r) for r in runs})
    for t in docs:
        w, hit, found = decontaminate.words_of(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := runs.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        yield len(w), sorted(hit), sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=6), st.lists(st.text("abc ", max_size=60), max_size=4))
def test_automaton(items, docs):
    known = [(decontaminate.words_of(t), frozenset([str(i)])) for i, t in enumerate(items)]
    merged = {}
    for w, ids in known:
        if w:
            merged[tuple(w)] = merged.get(tuple(w), frozenset()) | ids
    a = decontaminate.Automaton([(list(w), i) for w, i in merged.items()], 4)
    for t, (n, hit, found) in zip(docs, brute(docs, enumerate(items), 4)):
        runs, numbers = a.scan(decontaminate.words_of(t))
        assert [k for x, y in runs for k in range(x, y)] == hit
        assert sorted(set().union(*(a.ids[k] for k in numbers))) == found


def test_decontaminate(spark, monkeypatch):
    items = [(i, " ".join(DRAW.choice(WORDS[:30]) for _ in range(n))) for i, n in enumerate((3, 9, 10, 11, 30, 30, 60))] + [(7, None), (8, ""), (9, "..."), (None, "lost item"), (10, "unique")]
    items.append((11, items[4][1]))
    texts = [None, "", " ".join(WORDS[40:90]), items[4][1], "X " + items[4][1].upper() + " y", items[0][1] + " " + items[5][1], " ".join(items[6][1].split()[20:29]), "unique", items[3][1] * 2000, "a LOST item here"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hits long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (decontaminate.SHARD_WORDS, 40):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        found = decontaminate.scan(df, bench)
        got = {r["doc_id"]: r for r in decontaminate.digests(found).collect()}
        for i, (n, hit, ids) in enumerate(brute(texts, items, 10)):
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(ids), bool(hit)), i
            assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
    out = {r["doc_id"]: r for r in decontaminate.remove(found).collect()}
    halved = {r["doc_id"]: r["text"] for r in decontaminate.remove(found, longest=0.5).collect()}
    assert halved[4] == "" and halved[2] == texts[2] and halved[9] == "a  here" and out[9]["text"] == "a  here"
    assert out[4]["text"] == "X  y" and out[3]["text"] == "" and out[2]["text"] == texts[2] and out[0]["text"] is None and out[4]["n_hits"] == 5
    assert decontaminate.scan(df.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.digests(decontaminate.scan(df, bench.limit(0))).collect()} == {False}


def test_languages(spark):
    parts = {"xx": ["ka", "zu", "mo"], "yy": ["the", "ing", "er"], "zz": ["ção", "lha", "é"]}
    rows = []
    for i in range(900):
        lang = ["xx", "yy", "zz"][i % 3]
        rows.append((i, " ".join("".join(DRAW.choice(parts[lang]) for _ in range(3)) for _ in range(DRAW.randrange(3, 50))), lang))
    rows += [(5000, None, "xx"), (5001, "", "xx"), (5002, "12 !!", None), (5003, "kazumo", None), (5004, "² ½", "yy"), (5005, "the ing " * 50_000, None), (None, "er the", "yy")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.predict(df, langid.learn(df)).collect()}
    assert len(got) == len(rows)
    own = [r for r in rows[:900] if held(r[0])]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in own) / len(own) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (5000, 5001, 5002, 5004))
    assert got[5003]["lang_pred"] == "xx" and got[5005]["lang_pred"] == "yy" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(df, langid.learn(df.limit(0))).collect()} == {"und"}
    assert langid.predict(df.limit(0), {}).count() == 0


def ranking(texts):
    """The 400 most frequent n-grams by counting every substring of every marked word."""
    count = Counter()
    for text in texts:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            marked = f"_{w}_"
            count.update(marked[i:j] for i in range(len(marked)) for j in range(i + 1, min(i + 3, len(marked)) + 1) if marked[i:j] != "_")
    return sorted(count, key=lambda g: (-count[g], zlib.crc32(g.encode())))[:400]


def test_languages_by_brute_force(spark):
    letters = {"xx": "abcdefghij", "yy": "cdefghijkl", "zz": "ghijklmnoé"}
    word = lambda lang: "".join(DRAW.choice(letters[lang]) for _ in range(DRAW.randrange(1, 9)))
    rows = [(i, " ".join(word(lang) for _ in range(DRAW.randrange(1, 80))), lang) for i in range(240) for lang in [["xx", "yy", "zz"][i % 3]]]
    df = spark.createDataFrame(rows * 2 + [rows[1]] * 50, "doc_id long, text string, lang string")
    profiles = {k: ranking([t for i, t, lang in rows if lang == k and not held(i)]) for k in letters}
    learned = langid.learn(df)
    assert {k: sorted(p, key=p.get) for k, p in learned.items()} == profiles
    for r in langid.predict(df.distinct(), learned).collect():
        own = ranking([r["text"]])
        apart = {k: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own)) for k, p in profiles.items()}
        order = sorted(apart, key=lambda k: (apart[k], k))
        assert r["lang_pred"] == order[0] and r["score"] == apart[order[1]] / (apart[order[0]] + apart[order[1]])


def test_languages_of_few_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 5)
    ids = [i for i in range(200) if not held(i)]
    rows = [(ids[0], "aba cabab", "aa")] * 500 + [(i, "xyx zyx", "bb") for i in ids[1:]]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: sorted(p, key=p.get) for k, p in learned.items()} == {"aa": ranking(["aba cabab"]), "bb": ranking(["xyx zyx"])}


def test_ranking_counts_grams():
    words = langid._Words({"x": {}})
    text = "abba abc abba"
    want = Counter(g for w in text.split() for g in langid.grams_of(w))
    found, total = words.counts(text)
    names = {k: g for g, k in words.number.items()}
    assert {names[k]: n for k, n in zip(found.tolist(), total.tolist())} == dict(want)
