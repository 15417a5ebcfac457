"""SQL names against their DataFrame forms; rules of a language that is added."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import lexicon, register, scoring
from spanloom.operators import trimming, windows

DIR = "/root/testdata/sf0.001"


def spans(rows):
    return sorted((r.clip_id, round(r.start, 9), round(r.end, 9)) for r in rows)


def test_keep_spans_with_options_and_clips_without_words(spark):
    register.register(spark)
    words = [(1, 0.5, 1.0, "Um,"), (1, 1.0, 1.4, "so"), (1, 3.0, 3.4, "we"), (1, 3.35, 3.5, "uh"), (1, 9.9, 10.5, "go"), (2, 0.0, 0.05, "um"), (4, 50.0, 51.0, "outside"), (5, 1.0, 1.2, "end")]
    clips = [(1, 0.0, 10.0), (2, 0.0, 0.1), (3, 5.0, 9.0), (4, 0.0, 20.0), (5, 0.0, 4.0)]
    w, c = spark.createDataFrame(words, "clip_id int, start double, end double, text string"), spark.createDataFrame(clips, "clip_id int, start double, end double")
    table = c.withColumnsRenamed({"start": "clip_start", "end": "clip_end"}).join(w, "clip_id", "left").withColumn("extra", F.lit(1))
    for o in ({}, {"min_gap": 0.3, "keep_pause": 0.1}, {"fillers": False, "pad": 0.2}, {"min_span": 1.5}):
        text = "".join(f", {k} => {v}" for k, v in o.items())
        for by in ("PARTITION BY clip_id ORDER BY (start, end)", "PARTITION BY extra ORDER BY (clip_id, start, end)"):
            got = spark.sql(f"SELECT * FROM keep_spans(TABLE({{t}}) {by}{text})", t=table)
            assert dict(got.dtypes)["clip_id"] == "int"
            assert spans(got.collect()) == spans(trimming.keep_spans(w, c, **o).collect())


def test_keep_spans_names_what_is_missing(spark):
    register.register(spark)
    with pytest.raises(Exception, match="no clip_start, clip_end"):
        spark.sql("SELECT * FROM keep_spans(TABLE({t}) PARTITION BY clip_id)", t=spark.sql("SELECT 1 AS clip_id, 0D AS start, 1D AS end, 'a' AS text")).collect()


def test_scores_as_sql_functions_run_no_python(spark):
    register.register(spark)
    li = spark.read.parquet(f"{DIR}/lineitem.parquet")
    keys = list(scoring.CATEGORY_MAX)
    d = li.select(*[((F.col("l_partkey") * (k + 3)) % 40 - 5.0).alias(c) for k, c in enumerate(keys)], F.element_at(F.array(*map(F.lit, scoring.CLIP_TYPES)), (F.col("l_suppkey") % 12 + 1).cast("int")).alias("clip_type"), F.col("l_quantity").cast("double").alias("q"))
    shares = list(scoring.VIRALITY_SHARE)
    a = d.select(F.expr(f"clip_overall({', '.join(keys)})").alias("o"), F.expr(f"clip_virality({', '.join(shares)}, clip_type)").alias("v"), F.expr("interval_iou(hook, payoff, emotion, q)").alias("i"))
    b = d.select(scoring.overall({k: F.col(k) for k in keys}).alias("o"), scoring.virality({k: F.col(k) for k in shares}, F.col("clip_type")).alias("v"), scoring.iou(F.col("hook"), F.col("payoff"), F.col("emotion"), F.col("q")).alias("i"))
    assert "Python" not in a._jdf.queryExecution().executedPlan().toString()
    for x, y in zip(a.collect(), b.collect()):
        assert x.o == pytest.approx(y.o) and x.v == pytest.approx(y.v) and x.i == pytest.approx(y.i)


def test_a_language_that_is_added(spark):
    lexicon.add_language("DE", {"hook": [(r"\bniemand (sagt|erzählt)\b", 1.0)], "weak_start": [(r"^\s*(und|aber)\b", 0.8)]})
    try:
        s = spark.sql("SELECT 't' AS transcript_id, 'de' AS language, 9D AS duration, array(named_struct('text', 'Niemand erzählt dir das.'), named_struct('text', 'Und dann weiter.')) AS sentences")
        p = windows.profiles(s).first().profiles
        assert p[0].hook == pytest.approx(0.632121, abs=1e-6) and p[0].weak_start == 0 and p[1].hook == 0 and p[1].weak_start > 0.5
        assert lexicon.rules_for("de-AT") is lexicon.LANGUAGES["de"] and lexicon.rules_for("it") is lexicon.EN
    finally:
        del lexicon.LANGUAGES["de"]
    for code, rules in (("deu", {}), ("de", {"joke": []}), ("de", {"hook": [("(", 1.0)]}), ("de", {"hook": [("a", 0)]})):
        with pytest.raises((ValueError, re.error)):
            lexicon.add_language(code, rules)
