"""The pipeline stage by stage on the smallest tables, each stage against a plain-loop version of it."""

import re

import pytest

import corpus_pipeline as cp
from spanloom.llm import langid, queries, toxicity
from tests.llm import brute
from tests.llm.test_operators import _mixed, base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage, as dicts."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        out.append((name, before, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"] == [n for n, _ in cp.STAGES]
    for name, before, after in stages:
        assert 0 < after.count() <= before.count() and (name == "mixing" or after.columns == before.columns)


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows(after)) == {i for i, r in rows(before).items() if brute.toxicity_score(r.text, model) < 0.5}


def test_near_dedup_stage(stages):
    _, before, after = stages[1]
    assert set(rows(after)) == brute.kept_of_copies([(i, r.text) for i, r in rows(before).items()])


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    assert set(rows(after)) == {i for i, r in rows(before).items() if not brute.holds_item(items, r.text)}


def test_pii_stage(stages):
    _, before, after = stages[3]
    was, now = rows(before), rows(after)
    assert set(was) == set(now)
    for i, r in was.items():
        spans = sorted(((a, -b, k) for k, a, b in base_spans(r.text or "")))
        if not spans:
            assert now[i].text == r.text or re.search("<(IBAN|PHONE)>", now[i].text)
            continue
        out, past = [], 0
        for a, b, k in spans:
            if -b > past:
                out += [r.text[past : max(past, a)], f"<{k.upper()}>"]
            past = max(past, -b)
        want = "".join(out) + r.text[past:]
        assert now[i].text == want or re.search("<(IBAN|PHONE)>", now[i].text)
        assert now[i].n_chars == len(now[i].text) and not base_spans(now[i].text)


def test_mixing_stage(stages):
    _, before, after = stages[4]
    taken = _mixed([(i, r.source, len(brute.words(r.text)), 1.0) for i, r in rows(before).items()])
    assert {i: r.taken for i, r in rows(after).items()} == {i: n for i, n in taken.items() if n > 0}


def test_scores_and_languages_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {i: r.text for i, r in rows(docs).items()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - brute.toxicity_score(text[r.doc_id], model)) < 1e-9
    model = langid.fit(docs)
    for r in langid.identify(docs, model).collect():
        assert r.lang_pred == brute.language(text[r.doc_id], model)


def test_queries_and_sql_names():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
