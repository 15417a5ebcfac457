"""Interval algebra over tables of (group, start, end): gaps, union, subtraction, overlap joins, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _reach(group: str, start: str, end: str) -> Column:
    """Largest end of the rows before, in order of start."""
    return F.max(end).over(W.partitionBy(group).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))


def gaps(rows: DataFrame, group: str, start: str, end: str, least: float, total: DataFrame | None = None) -> DataFrame:
    """(group, gap_start, gap_end) of at least `least` between what intervals cover, from zero on; with `total` (group, duration) also to the end."""
    d = rows.select(F.col(group), F.col(start).alias("_s"), F.col(end).alias("_e"))
    if total is not None:
        d = d.unionByName(total.select(group, F.col("duration").alias("_s"), F.col("duration").alias("_e")))
    d = d.withColumn("gap_start", F.coalesce(_reach(group, "_s", "_e"), F.lit(0.0)))
    return d.where(F.col("_s") - F.col("gap_start") >= least).select(group, "gap_start", F.col("_s").alias("gap_end"))


def union(rows: DataFrame, group: str, start: str, end: str, slack: float = 0.02) -> DataFrame:
    """Maximal covered intervals; pieces closer than `slack` join."""
    reach = _reach(group, start, end)
    d = rows.withColumn("_new", F.when(F.col(start) <= reach + slack, 0).otherwise(1))
    d = d.withColumn("_island", F.sum("_new").over(W.partitionBy(group).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract(frames: DataFrame, cuts: DataFrame, group: str, start: str, end: str, least: float = 0.12) -> DataFrame:
    """What is left of each group's one interval after its cuts, in pieces of at least `least`; the whole interval if nothing is."""
    c = union(cuts, group, start, end).withColumnsRenamed({start: "_a", end: "_b"})
    d = frames.select(group, start, end).join(c, group, "left")
    w = W.partitionBy(group).orderBy("_a")
    lo = F.greatest(F.col(start), F.coalesce(F.lag("_b").over(w), F.col(start)))
    first = d.select(group, start, end, lo.alias("_lo"), F.coalesce("_a", end).alias("_hi"))
    tail = d.groupBy(group, start, end).agg(F.max("_b").alias("_m")).where(F.col("_m").isNotNull()).select(group, start, end, F.greatest(start, "_m").alias("_lo"), F.col(end).alias("_hi"))
    pieces = first.unionByName(tail)
    kept = pieces.where(F.col("_hi") - F.col("_lo") >= least).select(group, F.col("_lo").alias(start), F.col("_hi").alias(end))
    whole = frames.select(group, start, end).join(kept.select(group).distinct(), group, "left_anti")
    return kept.unionByName(whole)


def pairs_by_bin(rows: DataFrame, group: str, start: str, end: str, key: str, width: float) -> DataFrame:
    """Pairs of overlapping intervals of a group, each once (by start, then key).

    Intervals go to the time bins they touch and meet there, so a long group is cut
    into bins instead of joining whole; a pair is kept in the first bin both touch.
    """
    d = rows.select(group, F.col(start).alias("a0"), F.col(end).alias("a1"), F.col(key).alias("ka"))
    d = d.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a0") / width), F.floor(F.col("a1") / width))))
    e = d.withColumnsRenamed({"a0": "b0", "a1": "b1", "ka": "kb"})
    j = d.join(e, [group, "bin"]).where(((F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("ka") < F.col("kb")))) & (F.col("b0") < F.col("a1")))
    return j.where(F.col("bin") == F.floor(F.greatest("a0", "b0") / width)).drop("bin")


def clip_to(words: DataFrame, ranges: DataFrame, group: str, key: str) -> DataFrame:
    """Words that overlap a range (group, r_start, r_end, key), cut to it."""
    j = words.join(ranges, group).where((F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end")))
    return j.withColumns({"start": F.greatest("start", "r_start"), "end": F.least("end", "r_end")}).drop("r_start", "r_end")


def words_between(rows: DataFrame, start, end) -> DataFrame:
    """(transcript_id, pos, start, end, text) of the words that overlap a range of their row (columns or numbers), cut to it.

    The array is filtered before it is exploded, and only its own row is read: no join, no shuffle.
    """
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    inside = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.greatest(w["start"], a).alias("start"), F.least(w["end"], b).alias("end"), w["text"].alias("text"))), lambda w: w["end"] > w["start"])
    return rows.select("transcript_id", F.explode(inside).alias("w")).select("transcript_id", "w.*")


def spans_in_band(rows: DataFrame, group: str, idx: str, start: str, end: str, low: float, high: float) -> DataFrame:
    """(group, i, j, span) of all runs of rows whose span from the start of i to the end of j is low to high seconds.

    Starts and ends meet in time bins as wide as the band, so each start meets the two
    or three bins where its partners can end, not all of a long group.
    """
    width = max(high - low, 1e-9)
    a = rows.select(group, F.col(idx).alias("i"), F.col(start).alias("_a"))
    a = a.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_a") + low) / width), F.floor((F.col("_a") + high) / width))))
    b = rows.select(group, F.col(idx).alias("j"), F.col(end).alias("_b"), F.floor(F.col(end) / width).alias("_bin"))
    span = F.col("_b") - F.col("_a")
    return a.join(b, [group, "_bin"]).where((F.col("j") >= F.col("i")) & span.between(low, high)).select(group, "i", "j", span.alias("span"))


def total_duration(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, spans, kept): number and total length of each group's spans."""
    return spans.groupBy(group).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col(end) - F.col(start)).alias("kept"))


def running_offset(rows: DataFrame, group: str, order: list, length: str) -> DataFrame:
    """Sum of the lengths before each row."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def level_db(samples: DataFrame, group: list[str], value: str, n_min: int = 1) -> DataFrame:
    """Root mean square in dBFS of each group's samples (-1..1); -120 for silence or too few."""
    g = samples.groupBy(*group).agg(F.avg(F.col(value) * F.col(value)).alias("_m"), F.count(value).alias("_n"))
    return g.withColumn("db", F.when((F.col("_n") >= n_min) & (F.col("_m") > 0), 10 * F.log10("_m")).otherwise(-120.0)).drop("_m", "_n")


def louder_gaps(found: DataFrame, levels: DataFrame, key: list[str], db: float = -38.0, most: int = 40) -> DataFrame:
    """Gaps worth transcribing again: louder than `db`, the first `most` of a transcript."""
    d = found.join(levels, key).where(F.col("db") > db)
    return d.withColumn("_r", F.row_number().over(W.partitionBy(key[0]).orderBy("gap_start"))).where(F.col("_r") <= most).drop("_r")


def hotspots(candidates: DataFrame, blocks: DataFrame, top: int = 6) -> DataFrame:
    """The best candidates that lie inside each block (transcript_id, block, start_idx, end_idx)."""
    b = blocks.withColumnsRenamed({"start_idx": "_a", "end_idx": "_b"})
    j = candidates.join(b, "transcript_id").where((F.col("start_idx") >= F.col("_a")) & (F.col("end_idx") <= F.col("_b")))
    w = W.partitionBy("transcript_id", "block").orderBy(F.desc("score"), "start_idx", "end_idx")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("_a", "_b")


def nearest(left: DataFrame, right: DataFrame, key: str, t: str, row: str, tolerance: float) -> DataFrame:
    """left with `near_row`, `near_t` and `apart` of the nearest row of right in the same key, before or after, at most `tolerance` apart; null if there is none.

    Equally near rows go by time, then by `row`, the earlier and lower first.  Both sides meet in bins as wide as the
    tolerance, a left row in its own and the two beside it, so the work is in rows of a bin, not of a key.  `row` is
    unique in left; rows without key or time have no partner.
    """
    bin_ = lambda: F.floor(F.col(t) / tolerance)
    ls = left.select(F.col(row).alias("_l"), F.col(key).alias("_k"), F.col(t).alias("_t"), F.explode(F.array(bin_() - 1, bin_(), bin_() + 1)).alias("_b"))
    rs = right.select(F.col(row).alias("_r"), F.col(key).alias("_k"), F.col(t).alias("_u"), bin_().alias("_b"))
    apart = F.abs(F.col("_t") - F.col("_u"))
    best = ls.join(rs, ["_k", "_b"]).where(apart <= tolerance).groupBy("_l").agg(F.min(F.struct(apart.alias("apart"), F.col("_u").alias("near_t"), F.col("_r").alias("near_row"))).alias("_m"))
    return left.join(best, F.col(row) == F.col("_l"), "left").select(*left.columns, "_m.near_row", "_m.near_t", "_m.apart")
