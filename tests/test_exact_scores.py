"""Scores to the last bit: windows that nearly tie are ordered by it, so queries equal their SQL only if it is the same."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import lexicon
from spanloom.functions import text as T
from spanloom.operators import windows
from spanloom.plans import queries

TABLES = "/root/testdata/sf0.1"
#: Documents with windows that nearly tie.
DOCS = (145, 439, 3090, 4986, 8466)


def chain(values) -> float:
    total = 0.0
    for v in values:
        total += float(v)
    return total


def test_rule_scores_have_the_bits_of_the_c_library(spark):
    rules = [("one", 0.7), ("two", 0.35), ("three", 0.6), ("four", 0.45), ("five", 1.1)]
    texts = [" ".join(p for b, (p, _) in enumerate(rules) if k >> b & 1) for k in range(32)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(32, None)], "k int, t string").select("k", T.rule_score(F.col("t"), rules).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [1.0 - math.exp(-chain(w for b, (_, w) in enumerate(rules) if k >> b & 1)) for k in range(32)] + [0.0]


def test_rules_that_reach_too_many_sums_for_a_table(spark):
    rules = [(f"w{k}x", math.sqrt(k + 2)) for k in range(14)]
    got = spark.createDataFrame([("w1x w13x",), ("",)], "t string").select(T.rule_score(F.col("t"), rules).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([1.0 - math.exp(-(math.sqrt(3) + math.sqrt(15))), 0.0])


def _scorer(seed: int, n: int = 60) -> windows.Scorer:
    r = np.random.default_rng(seed)
    start = np.arange(n) * 2.4
    s = {"start": start, "end": start + 2.0, "pause_before": np.full(n, 0.4), "pause_after": np.full(n, 0.4), "n_words": np.full(n, 5.0), "text": ["So it goes."] * n}
    base = r.choice([0.0, 0.2592, 0.5034, 0.6501, 0.8775], n) * r.random(n)
    return windows.Scorer(s, {c: r.permutation(base) for c in (*lexicon.CATEGORIES, "weak_start")}, np.zeros(n))


@pytest.mark.parametrize("seed", range(3))
def test_windows_add_from_left_to_right(seed):
    sc = _scorer(seed)
    i, j = windows.in_band(sc.s["start"], sc.s["end"], sc.p["weak_start"])
    k = np.random.default_rng(seed).permutation(len(i))
    i, j = i[k], j[k]
    e = sc.p["emotion"]
    got = sc.parts(i, j)
    assert got["emotion"].tolist() == [0.7 * max(e[a : b + 1]) + 0.3 * chain(e[a : b + 1]) / (b - a + 1) for a, b in zip(i.tolist(), j.tolist())]
    assert got["duration_fit"].tolist() == [math.exp(-((sc.s["end"][b] - sc.s["start"][a] - 45.0) ** 2) / 968.0) for a, b in zip(i.tolist(), j.tolist())]
    assert [len(v) for v in sc.parts(i[:0], j[:0]).values()] == [0] * len(got)
    for a, b in [(0, 59), (3, 40), *zip(i[:40].tolist(), j[:40].tolist())]:
        total = {c: chain(sc.p[c][a : b + 1]) for c in lexicon.CATEGORIES}
        best = max(total, key=total.get)
        assert sc.dominant(a, b) == (lexicon.TYPE_OF[best] if total[best] > 0.6 else "other")


def test_durations_fit_as_the_c_library_says():
    x = np.arange(1, 400) * 0.4
    assert windows.bell(x, 45.0, 22.0).tolist() == [math.exp(-math.pow(v - 45.0, 2.0) / 968.0) for v in x.tolist()]


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A folder with the documents DOCS, and a connection to it."""
    at = tmp_path_factory.mktemp("few")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{TABLES}/documents.parquet' WHERE doc_id IN {DOCS}) TO '{at}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    return str(at), con


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["signal_profiles", "window_scores", "nms"])
def test_near_ties_are_ordered_as_in_sql(spark, few, name):
    at, con = few
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, queries.QUERIES[name](spark, at).select(*[f"`{c}`" for c in names]).toArrow().to_pylist())) == sorted(str(dict(zip(names, r))) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["analyze_documents", "export_csv", "export_json", "export_text", "export_plan", "compilation_plan"])
def test_clips_of_near_ties_equal_their_sql(spark, few, name):
    at, con = few
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, queries.QUERIES[name](spark, at).select(*[f"`{c}`" for c in names]).toArrow().to_pylist())) == sorted(str(dict(zip(names, r))) for r in want.fetchall())
