"""Column functions: words, rules, codes, names."""

import math
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import jsonrepair as J
from spanloom.functions import lexicon, scoring
from spanloom.functions import text as T


def one(spark, values, col, schema="v string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema).repartition(2)
    return [r.o for r in d.select("i", col(F.col("v")).alias("o")).orderBy("i").collect()]


def test_word_count_splits_at_no_break_spaces(spark):
    assert one(spark, ["a b c", "", " x ", None], T.word_count) == [3, 0, 1, 0]


def test_rule_scores_equal_python(spark):
    texts = ["Nobody tells you this?", "I NEVER did that, amazing!", "plain words", "C'ÉTAIT INCROYABLE, jamais", "and so the truth is: 25 percent", "Éa", "haha lol", "so anyway", "bref, on passe"]
    for rules in (*lexicon.EN.values(), *lexicon.FR.values()):
        want = [1 - math.exp(-sum(w for p, w in rules if re.search(p, t, re.I | re.U))) for t in texts]
        assert one(spark, texts, lambda c: T.rule_score(c, rules)) == pytest.approx(want)


def test_profile_tags(spark):
    d = spark.createDataFrame([("Nobody tells you the truth is this",)], "v string").select(T.profile(F.col("v"), lexicon.EN).alias("p")).first().p
    assert d.hook > 0.5 and "hook" in d.tags and d.payoff == 0


def test_filler_and_transition(spark):
    assert one(spark, ["Yeah, ", "yeah I went home today ok", "Let's move on", "um..."], T.is_filler) == [True, False, False, True]
    assert one(spark, ["Anyway, what now", "We go on", "moving on then"], T.is_transition) == [True, False, True]
    assert one(spark, ["um,", "Uhh…", "umbrella"], T.is_filler_word) == [True, True, False]


def test_hallucinations(spark):
    rows = [("Thank you.", 0.7, -0.9), ("thanks for watching", 0.55, 0.0), ("[Music]", 0.0, 0.0), ("(hm) no", 0.0, 0.0), ("", None, None), ("real speech goes here", 0.9, -0.9), ("Merci!", 0.5, 0.0)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n double, l double")
    got = [r.h for r in d.select("i", T.is_hallucination(F.col("t"), F.col("n"), F.col("l")).alias("h")).orderBy("i").collect()]
    assert got == [True, True, True, False, True, False, True]


def test_codes(spark):
    assert one(spark, [-5.0, 59.9, 61.0, 3725.0, 360000.0], T.fmt_ts, "v double") == ["00:00", "00:59", "01:01", "01:02:05", "100:00:00"]
    assert one(spark, ["#22C55E", "80FFFFFF", "#abc", "", None, "red"], T.hex_to_ass) == ["&H005EC522", "&H80FFFFFF", "&H00CCBBAA", "&H00FFFFFF", "&H00FFFFFF", "&H00DDEERR"]


def test_safe_stem_keeps_the_numbers_and_marks_that_sql_keeps(spark):
    odd = ["x² ½ Ⅷ ①", "e\u0301te\u0301", "a\u203fb", "\u24d0bc", "no\u200dne", "_k-1.5"]
    assert one(spark, odd, T.safe_stem) == ["x²_½_Ⅷ_①", "e\u0301te\u0301", "ab", "bc", "none", "_k-1.5"]


def test_safe_stem_and_excerpt(spark):
    assert one(spark, ["Été: a/b c!", "???", "x" * 80], T.safe_stem) == ["Été_ab_c", "clips", "x" * 60]
    long = " ".join(f"w{i}" for i in range(400))
    out = one(spark, ["short  text", long], T.excerpt)
    head, tail = out[1].split(" […] ")
    assert out[0] == "short text" and long.startswith(head) and long.endswith(tail) and len(head) <= 372 and len(tail) <= 217


def test_virality_and_overall(spark):
    d = spark.createDataFrame([(20.0, 20.0, 12.0, 9.0, 99.0, -3.0)], "hook double, payoff double, emotion double, curiosity double, standalone double, editability double")
    c = {k: F.col(k) for k in scoring.SCORE_KEYS}
    r = d.select(scoring.virality(c, F.lit("controversial")).alias("v"), scoring.overall(c).alias("o"), scoring.normalise_type(F.lit("A Hot-Take")).alias("t")).first()
    assert r.v == pytest.approx(87.6) and r.o == pytest.approx(71.0) and r.t == "controversial"


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"candidates":[{"start_index":1},{"start_index":2},{"start_in', [{"start_index": 1}, {"start_index": 2}]),
        ('```json\n{"clips": [{"a": 1,},]}\n```', [{"a": 1}]),
        ('Sure! [{"id": 1, "y": True}] // done', [{"id": 1, "y": True}]),
        ('{"start": 3, "note": "a } brace"}', [{"start": 3, "note": "a } brace"}]),
        ("“nothing”", []),
        (None, []),
        ('{"other": 1}', []),
    ],
)
def test_parse_list(text, want):
    assert J.parse_list(text, "candidates") == want


def test_numbers(spark):
    assert (J.as_float("7,5"), J.as_float("21/25"), J.as_float("x", 2.0), J.as_float(None, 1.0), J.as_int("2.5"), J.as_int("3.5")) == (7.5, 2125.0, 2.0, 1.0, 2, 4)
    assert one(spark, ["7,5 pts", "21/25", "", "abc"], T.as_number) == [7.5, 2125.0, None, None]
    d = spark.createDataFrame([('{"candidates":[{"a":1},{"a":2},{"a',)], "r string")
    assert J.repair(d, "r", "candidates").first()["items"] == ['{"a": 1}', '{"a": 2}']
