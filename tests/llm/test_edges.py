"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanloom.llm import decontam, langid, mixing, pii, quality, simhash, substring_dedup, toxicity, url_filter

CLASH = ["_key", "part", "row", "u", "chunk", "bytes", "c0", "_text_bytes", "_gone", "_k0", "_spans", "_new", "base", "spans", "root", "fp", "id", "component_id", "kept", "score", "_at", "s", "size", "target", "a.b", "x`y"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASH)
LONG = " ".join(f"w{i % 997} mail{i}@example.org" if i % 5000 == 0 else f"w{i * i % 7919}" for i in range(60_000))
ITEM = "Anna bought 12 apples for 3 dollars and later gave 4 apples to Maria so how many apples did Anna keep at home"
BASE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, LONG, "en", "a"), (5, "one two three four five six", "de", "b"), (5, "one two three four five six", "de", "b"),
    (6, "one two three four five six", None, "b"), (None, "no id here but a text", "fr", "c"), (None, None, None, None), (None, "no id here but a text", "fr", "c"), (7, f"so {ITEM} ok", "en", "a"), (8, "é" * 50, "fr", "c"), (9, "call +1 (555) 010-9999 or 4111 1111 1111 1111", "en", "c"),
]
ROWS = [(i, t, la, so, len(t) if t else None, *["mine"] * len(CLASH)) for i, t, la, so in BASE]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    bad, good = ["horrid", "vile", "nasty", "grim"], [f"plain{i}" for i in range(60)]
    return toxicity.train([" ".join(good[(k * 7 + j) % 60] for j in range(9)).encode() + b" " + bad[k % 4].encode() for k in range(60)], [" ".join(good[(k * 11 + j) % 60] for j in range(10)).encode() for k in range(120)])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ""), (3, "too short")], "item_id long, text string")


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def keeps(df, rows):
    """df holds just these rows, all columns."""
    assert df.columns == [c.strip() for c in ["doc_id", "text", "lang", "source", "n_chars", *CLASH]]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)


def test_decontamination(docs, empty, bench):
    assert [(r.doc_id, r.item_id, r.kind) for r in decontam.contaminated(docs, bench).collect()] == [(7, 1, "verbatim")]
    keeps(decontam.keep_clean(docs, bench), [r for r in ROWS if r[0] != 7])
    keeps(decontam.keep_clean(docs, bench.limit(0)), ROWS)
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.keep_clean(empty, bench).count() == 0


def test_substring(docs, empty):
    got = sorted((key((r.doc_id,)), r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 6).collect())
    words = {i: len((t or "").split()) for i, t, _, _ in BASE}
    long = next(r for r in got if r[0] == ("4",))
    assert long[1] == words[4] and 0 <= long[2] <= long[1]
    gone = {5: 6, 6: 6}
    want = [(key((i,)), len((t or "").split()), gone.get(i, len(t.split()) if i is None and t else 0)) for i, t, _, _ in BASE if i != 4]
    assert sorted(r for r in got if r[0] != ("4",)) == sorted(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_mixing(docs, empty):
    m = mixing.mix(docs, mixing.n_words(F.col("text")))
    assert m.columns == ["doc_id", "text", "lang", "source", "n_chars", *[c for c in CLASH if c not in mixing.RESULT], *mixing.RESULT]
    got = m.collect()
    assert len(got) == len(ROWS) and {r["a.b"] for r in got} == {r["x`y"] for r in got} == {r.u for r in got} == {"mine"}
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size and 0 <= mine[0].target - sum(r.taken for r in mine) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), mixing.n_words(F.col("text"))).collect()))
    assert mixing.mix(empty, mixing.n_words(F.col("text"))).count() == 0


def test_quality(docs, empty):
    got = quality.judge(docs, digest=True).collect()
    assert sorted((key((r.doc_id,)), r.n_words) for r in got) == sorted((key((i,)), len((t or "").split())) for i, t, _, _ in BASE)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    assert quality.judge(empty).count() == 0


def test_simhash(docs, empty):
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    assert got[1] == got[2] == got[3] == [1] and got[None].count(1) == 1 and got[5] == [5, 5] and got[6] == [5] and len(got[None]) == 3
    assert simhash.near_duplicates(empty).count() == 0
    # null ids stay; of equal texts the first id stays, with all its rows
    keeps(simhash.keep_one(docs), [r for r in ROWS if r[0] not in (2, 3, 6)])
    assert simhash.keep_one(empty).count() == 0


def test_toxicity(docs, empty, model):
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and not any(r.predicted for r in got if r.doc_id in (1, 2, 3))
    bad = {r.doc_id for r in got if r.predicted}
    keeps(toxicity.keep_clean(docs, model), [r for r in ROWS if r[0] not in bad or r[0] is None])
    assert toxicity.keep_clean(empty, model).count() == 0 and toxicity.score(empty, model).count() == 0


def test_pii(docs, empty):
    texts = {i: t for i, t, _, _ in BASE if i is not None}
    got = pii.redact(docs)
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert got.columns == docs.columns and rows[9].text == "call <PHONE> or <CARD>" and rows[9].n_chars == len(rows[9].text)
    assert rows[4].text.count("<EMAIL>") == 12 and "@" not in rows[4].text
    assert all(rows[i].text == texts[i] for i in texts if i not in (4, 9)) and {r["a.b"] for r in rows.values()} == {r._k0 for r in rows.values()} == {r.base for r in rows.values()} == {"mine"}
    assert pii.redact(empty).count() == 0 and pii.detect(empty).count() == 0


def test_langid(spark, docs, empty):
    train = spark.createDataFrame([(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 5, "de" if i % 2 else "en") for i in range(200)], "doc_id long, text string, lang string")
    m = langid.fit(train)
    got = langid.identify(docs, m).collect()
    assert len(got) == len(ROWS) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3)) and {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 8)} <= {"de", "en"}
    assert langid.identify(empty, m).count() == 0 and langid.fit(empty) is None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.com/en/" + "x" * 300_000, "http://a.com/en/1", "http://a.com/en/1", "https://b.net/de/2", "https://b.net/de/3?q", "HTTP://B.NET/de/4#f", "http://é.org/é", "://", "http://"]
    rows = [(i if i % 5 else None, u, "m", "m", "m", "m") for i, u in enumerate(urls * 3)]
    d = spark.createDataFrame(rows, "page_id long, url string, host string, row string, chunk string, `a.b` string")
    rules = [url_filter.rule("com/en/", False), url_filter.rule("net/de/", True)]
    got = url_filter.judge(d, rules).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    by = {}
    for r in got:
        by.setdefault((r.host, r.path), set()).add((r.rule, r.verdict, round(r.ratio, 9)))
    assert all(len({v for _, v, _ in x}) == 1 for x in by.values())
    assert {(r.rule, r.verdict) for r in got if r.host.endswith("b.net")} == {("net/de/", "allow")} and {(r.rule, r.verdict) for r in got if r.host == "a.com"} == {("com/en/", "block")}
    assert url_filter.judge(d.limit(0), rules).count() == 0 and len(url_filter.judge(d, []).collect()) == len(rows)


def test_stages(spark, docs, empty, tmp_path_factory):
    """Each stage on the edge rows and on no rows: it runs, and all but the last keep the columns."""
    at = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for name, stage in cp.STAGES:
        got = stage(spark, docs, at)
        n = got.count()
        assert (got.columns == docs.columns) == (name != "mixing") and 0 < n <= len(ROWS), name
        assert stage(spark, empty, at).count() == 0, name
