"""Outcome analytics: within-group z-scores, correlations, type ranking and weight suggestions.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import scoring

#: Rows with a signal that insights need, rows read at most, correlation that counts, largest nudge (fixed values).
MIN_SAMPLE, NEWEST, CLEAR, NUDGE = 5, 5000, 0.3, 0.25


def zscores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with z against the group's mean and population deviation; groups of one row or without spread go."""
    w = W.partitionBy("_g")
    d = rows.withColumn("_g", F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown")))
    d = d.withColumns({"_n": F.count(F.lit(1)).over(w), "_m": F.avg(value).over(w), "_sd": F.stddev_pop(value).over(w)})
    return d.where((F.col("_n") >= 2) & (F.col("_sd") > 0)).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_sd")).drop("_g", "_n", "_m", "_sd")


def pearson(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate, 0 for fewer than two rows or no spread; sums about zero, so shift large values first."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).cast("double")
    cov = n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x), n * F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y)
    return F.when((n >= 2) & (vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).otherwise(0.0)


def upper_median(rows: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """(group, median): element floor(n / 2) of the sorted values of each group, exactly, whatever its size and however its values lie.

    Approximate percentiles, which are off by 1 / `accuracy` of the rows at most, give two values that the median lies
    between; rows below are only counted and the distinct values between, a few thousandths of a large group, are
    sorted.  Groups too small for that are sorted whole.
    """
    d = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    off = 4 / accuracy
    near = F.percentile_approx("v", F.array(F.lit(0.5 - off), F.lit(0.5 + off)), accuracy)
    # n is large enough for a rank in the middle to be within the percentiles' own error of them
    small = F.count(F.lit(1)) < 2 * accuracy
    lim = d.groupBy(F.col("g").alias("lg")).agg(F.count(F.lit(1)).alias("n"), F.when(small, F.min("v")).otherwise(near[0]).alias("lo"), F.when(small, F.max("v")).otherwise(near[1]).alias("hi"))
    d = d.join(lim, F.col("g").eqNullSafe(F.col("lg")))
    # one row for what lies below, one for each distinct value between
    d = d.where(F.col("v") <= F.col("hi")).groupBy("g", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    upto = F.sum("c").over(W.partitionBy("g").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    half = F.floor(F.col("n") / 2)
    return d.withColumn("upto", upto).where((F.col("upto") > half) & (F.col("upto") - F.col("c") <= half)).select(F.col("g").alias(group), F.col("v").alias("median"))


def note(corr: Column) -> Column:
    return F.when(corr >= CLEAR, "higher scores here tracked with better performance").when(corr <= -CLEAR, "higher scores here tracked with WORSE performance").otherwise("no clear signal yet")


def newest(performance: DataFrame, limit: int = NEWEST, video: str | None = None) -> DataFrame:
    d = performance if video is None else performance.where(F.col("video_hash") == video)
    row = {k: F.col(k) for k in scoring.ENGAGEMENT}
    return d.orderBy(F.desc("logged_at"), F.desc("id")).limit(limit).withColumn("engagement", scoring.engagement(row))


def correlations(signal: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, correlation, note) of each measure with z."""
    one = signal.agg(*[F.round(pearson(m, "z"), 3).alias(m) for m in measures])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("correlation")) for m in measures])).alias("r")).select("r.*")
    return long.withColumn("note", note(F.col("correlation")))


def type_ranking(signal: DataFrame) -> DataFrame:
    return signal.groupBy(F.coalesce("clip_type", F.lit("other")).alias("clip_type")).agg(F.avg("z").alias("avg_z"), F.count(F.lit(1)).alias("n"))


def suggest(corr: DataFrame, weights: DataFrame) -> DataFrame:
    """(measure, weight) nudged by clear correlations, at least 1, rescaled to the old total."""
    d = weights.join(corr, "measure", "left")
    c = F.coalesce("correlation", F.lit(0.0))
    factor = 1.0 + F.when(F.abs(c) >= CLEAR, F.least(F.lit(NUDGE), F.greatest(F.lit(-NUDGE), c))).otherwise(0.0)
    d = d.withColumn("_w", F.greatest(F.lit(1.0), F.col("weight") * factor))
    everything = W.partitionBy()
    return d.select("measure", (F.col("_w") * F.sum("weight").over(everything) / F.sum("_w").over(everything)).alias("weight"))


def log(clips: DataFrame, entries: DataFrame) -> DataFrame:
    """Performance rows of requests (video_hash, rank, ...), each filled from its clip's snapshot where the request is silent."""
    both = [c for c in entries.columns if c in clips.columns and c not in ("video_hash", "rank")]
    j = entries.alias("e").join(clips.alias("c"), ["video_hash", "rank"], "left")
    rest = [c for c in dict.fromkeys([*entries.columns, *clips.columns]) if c not in ("video_hash", "rank", *both)]
    return j.select("video_hash", "rank", *[F.coalesce(F.col(f"e.{c}"), F.col(f"c.{c}")).alias(c) for c in both], *rest)


def entries(requests: DataFrame) -> DataFrame:
    """Requests coerced to performance rows: counts as whole numbers, scores as numbers, nulls as zero, platform `other` where unsaid."""
    kinds = {c: "long" for c in ("views", "likes", "comments", "shares")} | {c: "double" for c in ("duration", "overall", "virality")}
    out = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast(t) for c, t in kinds.items() if c in requests.columns}
    if "platform" in requests.columns:
        out["platform"] = F.coalesce(F.when(F.col("platform") != "", F.col("platform")), F.lit("other"))
    if "scores" in requests.columns:
        out["scores"] = F.to_json(F.create_map(*[x for k in scoring.SCORE_KEYS for x in (F.lit(k), F.coalesce(F.get_json_object("scores", f"$.{k}").try_cast("double"), F.lit(0.0)))]))
    return requests.withColumns(out)


def scan(performance: DataFrame, limit: int = 1000, video: str | None = None) -> DataFrame:
    """The newest rows with their scores decoded from JSON (broken JSON: no scores) and their engagement."""
    return newest(performance, limit, video).withColumn("scores", F.coalesce(F.from_json("scores", "map<string,double>"), F.create_map().cast("map<string,double>")))


def without(performance: DataFrame, ids: DataFrame) -> DataFrame:
    """The log less the rows of some ids (a table with `id`)."""
    return performance.join(ids.select("id").distinct(), "id", "left_anti")


def readiness(performance: DataFrame, group: str = "video_hash", value: str = "engagement") -> DataFrame:
    """One row: rows logged, rows with a signal (two or more in their group, with spread), how many it takes, and whether that is enough."""
    g = performance.groupBy(group).agg(F.count(F.lit(1)).alias("_all"), F.count(value).alias("_n"), (F.max(value) > F.min(value)).alias("_spread"))
    both = g.agg(F.coalesce(F.sum("_all"), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when((F.col("_n") >= 2) & F.col("_spread"), F.col("_n"))), F.lit(0)).alias("with_signal"))
    reason = F.when(F.col("count") == 0, "No performance logged yet.").when(F.col("with_signal") < MIN_SAMPLE, F.concat(F.lit("only "), F.col("with_signal").cast("string"), F.lit(f" rows can be compared, {MIN_SAMPLE} are needed")))
    return both.select("count", "with_signal", F.lit(MIN_SAMPLE).alias("need"), (F.col("with_signal") >= MIN_SAMPLE).alias("ready"), reason.alias("reason"))


def run_stats(sentences: DataFrame, blocks: DataFrame, pool: DataFrame, merged: DataFrame, final: DataFrame, requested: int, key: str = "transcript_id") -> DataFrame:
    """A row for each transcript: what was requested, and how many sentences, blocks, candidates (before and after merging) and final clips there are, with the final ones by type."""
    counts = [(sentences, "sentences"), (blocks, "blocks"), (pool, "candidates_pass1"), (merged, "candidates_after_merge"), (final, "final")]
    out = None
    for d, name in counts:
        n = d.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, key, "left")
    kinds = final.groupBy(key, "clip_type").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clip_type", "n")))).alias("types"))
    out = out.join(kinds, key, "left").withColumns({name: F.coalesce(name, F.lit(0)) for _, name in counts})
    return out.withColumn("requested", F.lit(requested))
