"""SQL names for the engine: table functions and Python functions where SQL has no expression, SQL functions where it has one."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from spanloom.functions import jsonrepair, scoring
from spanloom.functions import text as T


def repaired_json(text: pd.Series) -> pd.Series:
    """The reply as well-formed JSON, or null."""

    def one(t):
        found = jsonrepair.parse(t) if t else None
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return text.map(one)


class ReplyItems:
    """A row for each object listed under a key of a reply."""

    def eval(self, text: str, key: str):
        for k, item in enumerate(jsonrepair.parse_list(text, key) if text else []):
            yield k, json.dumps(item, ensure_ascii=False)


class KeepSpans:
    """Spans to keep of each clip, as `trimming.keep_spans` has them, from a table of its words.

        SELECT * FROM keep_spans(TABLE(words) PARTITION BY clip_id ORDER BY (start, end), min_gap => 0.6)

    The table has clip_id, clip_start, clip_end, start, end and text (extra columns are ignored); a clip without words is
    one row with a null start.  A partition may hold several clips if it is ordered by clip_id first.  What is held is
    the cuts of one clip.
    """

    COLUMNS = ("clip_id", "clip_start", "clip_end", "start", "end", "text")
    STRIP = re.compile(r"^[ .,!?…-]+|[ .,!?…-]+$")

    @staticmethod
    def analyze(words: AnalyzeArgument, min_gap=None, keep_pause=None, pad=None, min_span=None, fillers=None) -> AnalyzeResult:
        if not words.isTable:
            raise ValueError("keep_spans takes a table: keep_spans(TABLE(words) PARTITION BY clip_id ORDER BY (start, end))")
        missing = [c for c in KeepSpans.COLUMNS if c not in words.dataType.names]
        if missing:
            raise ValueError(f"keep_spans: the table has no {', '.join(missing)}")
        return AnalyzeResult(StructType([StructField("clip_id", words.dataType["clip_id"].dataType), StructField("start", DoubleType()), StructField("end", DoubleType())]))

    def __init__(self):
        self.clip = None

    def eval(self, row: Row, min_gap: float = 0.6, keep_pause: float = 0.35, pad: float = 0.06, min_span: float = 0.12, fillers: bool = True):
        key, lo, hi, a, b, text = (row[c] for c in self.COLUMNS)
        if self.clip is None or self.clip[0] != key:
            yield from self.terminate()
            self.clip, self.reach, self.spoken, self.cuts = (key, float(lo), float(hi)), float(lo), False, []
            self.min_gap, self.half, self.min_span = float(min_gap), max(0.0, float(keep_pause)) / 2, float(min_span)
        if a is None or b is None or not (b > lo and a < hi):
            return
        self.spoken = True
        if a - self.reach > self.min_gap:
            self.cuts.append((self.reach + self.half, a - self.half))
        if fillers and self.STRIP.sub("", text or "").lower() in T.FILLER_WORDS:
            self.cuts.append((max(float(lo), a - float(pad)), min(float(hi), b + float(pad))))
        self.reach = max(self.reach, b)

    def terminate(self):
        if self.clip is None:
            return
        (key, at, hi), found = self.clip, False
        if self.spoken and hi - self.reach > self.min_gap:
            self.cuts.append((self.reach + self.half, hi - self.half))
        end = None
        for a, b in sorted(c for c in self.cuts if c[1] > c[0]):
            if end is None or a > end + 0.02:
                if a - at >= self.min_span:
                    found = True
                    yield key, at, a
                end = b
            end = max(end, b)
            at = max(at, end)
        if hi - at >= self.min_span or not found:
            yield (key, at, hi) if hi - at >= self.min_span else (key, self.clip[1], hi)
        self.clip = None


def _sql_functions() -> dict[str, str]:
    """SQL text of the scoring functions: the optimiser sees through them, so no Python runs."""
    keys = ", ".join(f"{k} DOUBLE" for k in scoring.CATEGORY_MAX)
    hull = "(greatest(a1, b1) - least(a0, b0))"
    total = " + ".join(f"least({cap}D, greatest(0D, {k})) / {cap}D * {cap}D" for k, cap in scoring.CATEGORY_MAX.items())
    shares = " + ".join(f"{k} / {scoring.CATEGORY_MAX[k]}D * 100 * {share}D" for k, share in scoring.VIRALITY_SHARE.items())
    bonus = " ".join(f"WHEN '{t}' THEN {b}D" for t, b in scoring.VIRALITY_BONUS.items())
    return {
        "interval_iou(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE)": f"CASE WHEN {hull} > 0 THEN greatest(0D, least(a1, b1) - greatest(a0, b0)) / {hull} ELSE 0D END",
        f"clip_overall({keys})": f"({total}) * 100D / {sum(scoring.CATEGORY_MAX.values())}D",
        f"clip_virality({', '.join(f'{k} DOUBLE' for k in scoring.VIRALITY_SHARE)}, clip_type STRING)": f"least(100D, {shares} + CASE clip_type {bonus} ELSE 0D END)",
    }


def register(spark: SparkSession) -> None:
    """For SQL: repaired_json(text), reply_items(text, key), keep_spans(TABLE(words)), interval_iou, clip_overall and clip_virality."""
    spark.udf.register("repaired_json", F.pandas_udf(repaired_json, "string"))
    spark.udtf.register("reply_items", F.udtf(ReplyItems, returnType="pos int, item string"))
    spark.udtf.register("keep_spans", F.udtf(KeepSpans))
    for signature, body in _sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
