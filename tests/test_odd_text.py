"""Marks, joiners, ties, separators and other numbers in texts: the clips and exports of such documents equal their SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import lexicon
from spanloom.functions import text as T
from spanloom.operators import segment, windows
from spanloom.plans import queries

ODD = ["só", "été", "x\x1fy", "\x1funit", "x²", "½", "ⓐbc", "a‿b", "no‍ne", "क्षि", "cost̀", "İx", "ΣΑΣ", 'a"b\\c']
PLAIN = "honestly the truth is that so crazy and nobody knows why but i was crying because it was amazing , right ? what happened next blew my mind . let me tell you a secret :".split()


def words(k: int) -> list[str]:
    """240 words, one of ODD after every third, alone in even documents, before or after its neighbour in odd ones."""
    odd, base = ODD[k % len(ODD)], [PLAIN[(i * 7 + k) % len(PLAIN)] for i in range(240)]
    if k < len(ODD):
        return [x for i, w in enumerate(base) for x in ([w, odd] if i % 3 == 0 else [w])]
    return [w + odd if i % 3 == 0 else odd + w if i % 7 == 0 else w for i, w in enumerate(base)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with such documents, and a connection to it."""
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, " ".join(words(k)), "fr" if k % 3 == 0 else "en", "s") for k in range(2 * len(ODD))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["sentences_documents", "signal_profiles", "analyze_documents", "export_csv", "export_json", "export_text", "compilation_plan", "export_plan"])
def test_odd_text_equals_its_sql(spark, odd, name):
    at, con = odd
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, queries.QUERIES[name](spark, at).select(*[f"`{c}`" for c in names]).toArrow().to_pylist())) == sorted(str(dict(zip(names, r))) for r in want.fetchall())


def test_words_are_split_alike_in_columns_and_folds(spark):
    texts = ["a\x1fb \x1c c", " x　y ", "\x1f", "", " \t"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("w")).collect()
    assert [segment.split(t) for t in texts] == [r.w for r in got]
    assert segment.sentence_text(["\x1fa", "\x1d", ",", "b\x1e"]) == "\x1fa \x1d, b\x1e"


def test_marks_end_words_of_rules(spark):
    texts = ["só it goes", "so it goes", "a‿so", "éso", "it is amazinǵ now"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.profile(F.col("t"), lexicon.EN).alias("p")).orderBy("k")
    rows = [r.p for r in d.collect()]
    assert rows[0].weak_start == rows[1].weak_start > 0 and rows[3].weak_start == 0 and rows[4].emotion > 0


NEUTRAL = "paper lamp river stone window garden table bread cloud wheel copper basket".split()
SAYINGS = "so crazy|nobody knows|the truth is|this blew my mind|let me tell you a secret|25 percent of people|honestly|it is amazing|i was crying|never again|it makes no sense|in 10 years".split("|")
ARABIC = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
TURNED = {
    "none": [str],
    "numbers": [lambda s: s.translate(ARABIC), lambda s: s + "٣", lambda s: "Ⅷ" + s, lambda s: s + "१ "],
    "letters": [lambda s: s.replace("i", "ı"), lambda s: s.replace("s", "ſ"), lambda s: s.replace("i", "İ")],
    "capitals": [lambda s: s + " so said Partİ İnc. today", lambda s: s + " again . whİch we saw", lambda s: "KİTAP BİR ΟΔΟΣ " + s, lambda s: "kitap οδοσ " + s],
    "gaps": [lambda s, x=x: s.replace(" ", x) for x in "\xa0\u3000\u2028\x0b\x85\u202f"] + [lambda s: s + " \xa0?", lambda s: "\u2009 " + s + "\xa0", lambda s: s + "\xa0 ,"],
}


def said(k: int, turned) -> str:
    """Plain sentences, each with a saying of the rules, every second one turned odd."""
    out = []
    for i in range(14):
        out += [NEUTRAL[(i * 5 + k + n) % 12] for n in range(5 + i * k % 4)]
        out += [(turned[k % len(turned)] if i % 2 else str)(SAYINGS[(i * 7 + k) % 12]), "." if i % 3 else ", and"]
    return " ".join(out)


@pytest.fixture(scope="module")
def sayings(spark, tmp_path_factory):
    """A connection to a table of such documents for each kind, and their folder."""
    at, con = str(tmp_path_factory.mktemp("sayings")), duckdb.connect()
    for kind, turned in TURNED.items():
        rows = [(k, said(k, turned), "fr" if k % 5 == 4 else "en", "s") for k in range(24)]
        rows += [(None, said(k, turned), "en", "s") for k in (24, 25)] if kind == "none" else []
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/{kind}/documents.parquet")
    return at, con


def differing(spark, sayings, kind, name) -> list:
    at, con = sayings
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{at}/{kind}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = Counter(map(str, queries.QUERIES[name](spark, f"{at}/{kind}").select(*[f"`{c}`" for c in names]).toArrow().to_pylist()))
    want = Counter(str(dict(zip(names, r))) for r in want.fetchall())
    assert want
    return [*(got - want).elements(), *(want - got).elements()]


@pytest.mark.parametrize("kind", list(TURNED))
@pytest.mark.parametrize("name", ["export_csv", "export_text", "export_json", "compilation_plan"])
def test_sayings_equal_their_sql(spark, sayings, name, kind):
    assert differing(spark, sayings, kind, name) == []


def test_rules_read_numbers_spaces_and_letters_as_sql_does(spark):
    texts = ["25 percent", "٢٥ percent", "so the", "so٣", "ſo", "İf", "ıf", "so\xa0the", "so\x0bthe", "a\x85so"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    hits = lambda p: [r.m for r in d.select("k", T.matches(T.bare(F.col("t")), p).alias("m")).orderBy("k").collect()]
    assert hits(r"\b\d{2,}\s?percent\b") == [True] + [False] * 9
    assert hits(r"\bso\b") == [False, False, True, True, False, False, False, True, True, True]
    assert hits(r"\bso\s+the\b") == [k == 2 for k in range(10)] and hits(r"\bif\b") == [k == 5 for k in range(10)]
    assert hits("a.so") == [k == 9 for k in range(10)]


def test_white_space_is_unicodes_or_sqls(spark):
    texts = ["a\xa0b c", "\u3000 a\x0b", "a\x85\tb"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for white in (T.UNICODE, T.SQL):
        assert [segment.split(t, white) for t in texts] == [r.w for r in d.select(T.words(F.col("t"), white).alias("w")).collect()]
    assert [segment.split(t, T.SQL) for t in texts] == [["a\xa0b", "c"], ["\u3000", "a\x0b"], ["a\x85", "b"]]
    assert segment.sentence_text(["a\xa0,", "\xa0"], T.SQL) == "a\xa0, \xa0" and segment.sentence_text(["a\xa0,", "\xa0"]) == "a,"
    assert d.select(T.safe_stem(F.col("t"), 60, T.SQL).alias("s")).first().s == "ab_c"


def test_capitals_are_lowered_as_in_sql(spark):
    d = spark.createDataFrame([("KİTAP ΟΔΟΣ",)], "t string")
    assert d.select(T.topic_tokens(F.col("t"), T.SQL).alias("k")).first().k == ["kitap", "οδοσ"]
    assert not segment.ends_sentence("İnc.", T.SQL) and segment.ends_sentence("İnc.") and T.SQL.lower("WHİCH") == "which"


def test_rules_in_python_equal_those_in_columns(spark):
    """Scores, fillers, transitions and topics of odd texts, bit by bit, and plans of clips without a rule in the JVM."""
    texts = [" ".join(words(k)[i : i + 9]) for k in range(2 * len(ODD)) for i in range(0, 90, 9)] + [said(k, ts)[a : a + 60] for ts in TURNED.values() for k in range(9) for a in (0, 61, 130)]
    texts += ["", "haha", "Yeah.", "yeah\xa0!", "let's move on", "İt turns out", "été́ est-ce que", "Ω 25 % .", "d'accord", "voilà pourquoi", "éso", "so"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    cats = (*lexicon.CATEGORIES, "weak_start")
    for rules in (lexicon.EN, lexicon.FR):
        want = [tuple(r.p[c] for c in cats) for r in d.select("k", T.profile(F.col("t"), rules).alias("p")).orderBy("k").collect()]
        assert list(map(tuple, windows.Rules(rules).scores(texts).tolist())) == want
    for white in (T.UNICODE, T.SQL):
        got = d.select("k", T.is_filler(F.col("t")).alias("f"), (T.is_transition(F.col("t")) | T.is_filler(F.col("t"))).alias("x"), T.topic_tokens(F.col("t"), white).alias("k3")).orderBy("k").collect()
        assert [(windows.is_filler(t), windows.is_tail(t), segment.topic_set(t, white)) for t in texts] == [(r.f, r.x, set(r.k3)) for r in got]
    rows = spark.createDataFrame([("a", "en", 400.0, texts)], "transcript_id string, language string, duration double, w array<string>")
    built = rows.select("transcript_id", F.transform("w", lambda t: F.struct(t.alias("text"))).alias("sentences"))
    for white in (T.UNICODE, T.SQL):
        assert segment.topic_shifts(texts, white=white) == segment.topic_array(built, white=white).first().topic
    for name in ("analyze_documents", "window_scores", "nms", "signal_profiles"):
        assert "RLIKE" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
