"""Keep-span planning: filler words and long pauses are cut out of a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import intervals


def keep_spans(words: DataFrame, clips: DataFrame, key: str = "clip_id", min_gap: float = 0.6, keep_pause: float = 0.35, pad: float = 0.06, min_span: float = 0.12, fillers: bool = True) -> DataFrame:
    """(key, start, end) to keep of each clip (key, start, end) given its words (key, start, end, text).

    Cuts are fillers with a pad and what pauses have beyond `keep_pause`; a clip without words stays whole.
    """
    c = clips.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    w = words.join(c, key).where((F.col("end") > F.col("_s")) & (F.col("start") < F.col("_e")))
    half = max(0.0, keep_pause) / 2
    g = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    before = F.greatest("_s", F.coalesce(F.max("end").over(g), F.col("_s")))
    pauses = w.withColumn("_p", before).where(F.col("start") - F.col("_p") > min_gap).select(key, (F.col("_p") + half).alias("start"), (F.col("start") - half).alias("end"))
    last = w.groupBy(key).agg(F.max("end").alias("_p"), F.first("_s").alias("_s"), F.first("_e").alias("_e")).withColumn("_p", F.greatest("_p", "_s")).where(F.col("_e") - F.col("_p") > min_gap).select(key, (F.col("_p") + half).alias("start"), (F.col("_e") - half).alias("end"))
    cuts = pauses.unionByName(last)
    if fillers:
        cuts = cuts.unionByName(w.where(T.is_filler_word(F.col("text"))).select(key, F.greatest("_s", F.col("start") - pad).alias("start"), F.least("_e", F.col("end") + pad).alias("end")))
    return intervals.subtract(clips, cuts.where("end > start"), key, "start", "end", min_span)


def is_noop(n_spans: Column, first: Column, last: Column, start: Column, end: Column) -> Column:
    return (n_spans == 1) & (F.abs(first - start) < 1e-6) & (F.abs(last - end) < 1e-6)
