"""Every core query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from spanloom.plans import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def ordered(rows, names):
    """Rows with columns by name; floats of six digits, so that sums in another order agree."""
    at = [names.index(c) for c in sorted(names)]
    show = lambda x: "" if x is None else x if isinstance(x, str) else str(x) if isinstance(x, bool) or not isinstance(x, (int, float)) else "nan" if math.isnan(x) else f"{float(x):.6g}"
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want.fetchall(), names)


def test_keep_spans_plans_whole_conversations(spark):
    ends = {r.transcript_id: r.duration for r in queries._conversations(spark, DIR).select("transcript_id", "duration").collect()}
    last = {}
    for r in queries.QUERIES["keep_spans"](spark, DIR).collect():
        last[r.clip_id] = max(r.end, last.get(r.clip_id, 0.0))
    assert max(ends.values()) > 60 and all(ends[k] - 1.0 < v <= ends[k] + 1e-6 for k, v in last.items())
