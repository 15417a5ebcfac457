"""The engine's queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import shared
from spanloom.functions import jsonrepair, lexicon, register, scoring
from spanloom.functions import text as T
from spanloom.operators import camera, captions, insights, intervals, long, models, rank, segment, trimming, windows
from spanloom.plans import analyze, folds
from spanloom.sinks import exports
from spanloom.sources import audio, media
from spanloom.sources import transcripts as TR

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(ts) -> F.Column:
    """Seconds since the epoch of a time without zone (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def intervals_of_events(spark, d) -> DataFrame:
    """Each event as an interval that starts at its time and lasts value * 60 seconds, an hour at most."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("s")).withColumn("e", F.col("s") + F.least(F.lit(3600.0), F.abs("value") * 60.0))


_EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + least(3600.0, abs(value) * 60.0) AS e FROM events)"


# ---- intervals ------------------------------------------------------------------


@query(f"""WITH {_EV}, p AS (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ev)
SELECT user_id, r AS gap_start, s AS gap_end FROM p WHERE r IS NOT NULL AND s - r >= 2.5""")
def speech_gaps(spark, d):
    """Gaps of at least 2.5 s that no interval covers."""
    return intervals.gaps(intervals_of_events(spark, d), "user_id", "s", "e", 2.5).where("gap_start > 0")


@query(f"""WITH {_EV} SELECT a.event_id AS ka, b.event_id AS kb, (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) AS iou
FROM ev a JOIN ev b ON a.user_id = b.user_id AND (a.s < b.s OR (a.s = b.s AND a.event_id < b.event_id)) AND b.s < a.e""")
def interval_iou(spark, d):
    """Overlap share of all overlapping pairs of a user."""
    j = intervals.pairs_by_bin(intervals_of_events(spark, d), "user_id", "s", "e", "event_id", 3600.0)
    return j.select("ka", "kb", scoring.iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("iou"))


_UN = f"""{_EV}, n AS (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.02 THEN 0 ELSE 1 END AS f FROM ev),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n), u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k)"""


@query(f"WITH {_UN} SELECT user_id, s, e FROM u")
def interval_union(spark, d):
    """U4: maximal covered intervals with a slack of 0.02 s."""
    return intervals.union(intervals_of_events(spark, d), "user_id", "s", "e").select("user_id", "s", "e")


@query(f"""WITH {_UN}, f AS (SELECT user_id, min(s) - 60 AS fs, max(e) + 60 AS fe FROM ev GROUP BY user_id),
c AS (SELECT u.user_id, fs, fe, s, e, lag(e) OVER (PARTITION BY u.user_id ORDER BY s) AS pe FROM u JOIN f USING (user_id)),
p AS (SELECT user_id, greatest(fs, coalesce(pe, fs)) AS s, s AS e FROM c UNION ALL SELECT user_id, greatest(any_value(fs), max(e)), any_value(fe) FROM c GROUP BY user_id)
SELECT user_id, s, e FROM p WHERE e - s >= 0.12""")
def interval_subtract(spark, d):
    """What is left of each user's padded range after its intervals."""
    ev = intervals_of_events(spark, d)
    frames = ev.groupBy("user_id").agg((F.min("s") - 60).alias("s"), (F.max("e") + 60).alias("e"))
    return intervals.subtract(frames, ev.select("user_id", "s", "e"), "user_id", "s", "e")


@query("SELECT l_orderkey, l_linenumber, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS \"offset\" FROM lineitem")
def running_offset(spark, d):
    """Running sum of the lengths before each row."""
    rows = intervals.running_offset(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "offset")


@query("SELECT user_id, event_type, CASE WHEN avg(v * v) > 0 THEN 10 * log10(avg(v * v)) ELSE -120.0 END AS db FROM (SELECT user_id, event_type, value / 100.0 AS v FROM events) GROUP BY ALL")
def level_db(spark, d):
    """Root mean square in dB."""
    return intervals.level_db(table(spark, d, "events").withColumn("v", F.col("value") / 100.0), ["user_id", "event_type"], "v")


@query(f"""WITH {_EV}, p AS (SELECT a.event_id AS event_id, b.event_id AS near_row, abs(a.s - b.s) AS apart, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.s, b.event_id) AS n
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.s - b.s) <= 86400.0 WHERE a.event_type = 'click' AND b.event_type = 'view')
SELECT e.event_id AS event_id, near_row, apart FROM ev e LEFT JOIN (SELECT * FROM p WHERE n = 1) p USING (event_id) WHERE event_type = 'click'""")
def frame_zip(spark, d):
    """Each sample with the nearest frame of its group, within a day."""
    e = intervals_of_events(spark, d).select("event_id", "user_id", "event_type", "s")
    of = lambda t: e.where(F.col("event_type") == t).drop("event_type")
    return intervals.nearest(of("click"), of("view"), "user_id", "s", "event_id", 86400.0).select("event_id", "near_row", "apart")


# ---- analytics ------------------------------------------------------------------

_Z = "z AS (SELECT event_type, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, value, count(*) OVER w AS n, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id))"


@query(f"WITH {_Z} SELECT event_type, avg(z) AS avg_z, count(*) AS n FROM z WHERE n >= 2 AND sd > 0 GROUP BY event_type")
def zscore_by_type(spark, d):
    """Mean within-user z-score and count by type."""
    z = insights.zscores(table(spark, d, "events"), "user_id", "value").withColumnRenamed("event_type", "clip_type")
    return insights.type_ranking(z).withColumnRenamed("clip_type", "event_type")


@query("""SELECT c_mktsegment, CASE WHEN n >= 2 AND vx > 0 AND vy > 0 THEN cov / (sqrt(vx) * sqrt(vy)) ELSE 0.0 END AS correlation FROM (
SELECT c_mktsegment, count(*)::DOUBLE AS n, count(*)::DOUBLE * sum(x * y) - sum(x) * sum(y) AS cov, count(*)::DOUBLE * sum(x * x) - sum(x) * sum(x) AS vx, count(*)::DOUBLE * sum(y * y) - sum(y) * sum(y) AS vy
FROM (SELECT c_mktsegment, o_totalprice / 1000 AS x, c_acctbal / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)""")
def pearson_by_group(spark, d):
    """A4: Pearson's correlation from moment sums, 0 without spread."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", (F.col("o_totalprice") / 1000).alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    return j.groupBy("c_mktsegment").agg(insights.pearson("x", "y").alias("correlation"))


_WEIGHTS = list(scoring.CATEGORY_MAX.items())


@query("""WITH b AS (SELECT toxic, quality, n_chars / 1000.0 AS k, length(regexp_replace(text, '[^!]', '', 'g'))::DOUBLE AS bang, length(regexp_replace(text, '[^,]', '', 'g'))::DOUBLE AS comma FROM labels JOIN documents USING (doc_id)),
m AS (SELECT unnest([{'m': 'hook', 'x': k}, {'m': 'payoff', 'x': -k}, {'m': 'emotion', 'x': bang}, {'m': 'curiosity', 'x': comma}, {'m': 'standalone', 'x': toxic::DOUBLE}, {'m': 'editability', 'x': -toxic::DOUBLE}]) AS r, quality::DOUBLE AS y FROM b),
s AS (SELECT r.m AS measure, count(*)::DOUBLE AS n, sum(r.x) AS sx, sum(y) AS sy, sum(r.x * y) AS sxy, sum(r.x * r.x) AS sxx, sum(y * y) AS syy FROM m GROUP BY 1),
c AS (SELECT measure, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0.0 END AS corr FROM s),
w AS (SELECT * FROM (VALUES ('hook', 25.0), ('payoff', 25.0), ('emotion', 15.0), ('curiosity', 15.0), ('standalone', 10.0), ('editability', 10.0)) t(measure, weight)),
f AS (SELECT w.measure, weight::DOUBLE AS weight, greatest(1.0, weight::DOUBLE * (1 + CASE WHEN abs(corr) >= 0.3 THEN least(0.25, greatest(-0.25, corr)) ELSE 0.0 END)) AS nw FROM w LEFT JOIN c USING (measure))
SELECT measure, nw * sum(weight) OVER () / sum(nw) OVER () AS weight FROM f""")
def suggest_weights(spark, d):
    """Weights nudged by clear correlations, at the old total."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    count = lambda c: F.length(F.regexp_replace("text", f"[^{c}]", "")).cast("double")
    k, toxic = F.col("n_chars") / 1000.0, F.col("toxic").cast("double")
    m = j.select(F.col("quality").cast("double").alias("z"), k.alias("hook"), (-k).alias("payoff"), count("!").alias("emotion"), count(",").alias("curiosity"), toxic.alias("standalone"), (-toxic).alias("editability"))
    one = m.agg(*[insights.pearson(c, "z").alias(c) for c in scoring.SCORE_KEYS])
    corr = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("correlation")) for c in scoring.SCORE_KEYS])).alias("r")).select("r.*")
    return insights.suggest(corr, spark.createDataFrame(_WEIGHTS, "measure string, weight double"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def type_breakdown(spark, d):
    """A1: counts by type."""
    return rank.type_breakdown(table(spark, d, "events"), "event_type")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view')::DOUBLE AS views, count(*) FILTER (event_type = 'click')::DOUBLE AS likes, count(*) FILTER (event_type = 'purchase')::DOUBLE AS comments, count(*) FILTER (event_type = 'signup')::DOUBLE AS shares FROM events GROUP BY 1)
SELECT user_id, views + 3 * likes + 5 * comments + 8 * shares AS engagement FROM c ORDER BY engagement DESC, user_id LIMIT 20""")
def engagement_topk(spark, d):
    """A2, T4: the 20 users of the highest engagement."""
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1)).cast("double")
    c = table(spark, d, "events").groupBy("user_id").agg(n("view").alias("views"), n("click").alias("likes"), n("purchase").alias("comments"), n("signup").alias("shares"))
    return c.select("user_id", scoring.engagement({k: F.col(k) for k in scoring.ENGAGEMENT}).alias("engagement")).orderBy(F.desc("engagement"), "user_id").limit(20)


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[(count(*) // 2) + 1] AS median FROM lineitem GROUP BY 1")
def median_upper(spark, d):
    """A10: upper median by index."""
    return insights.upper_median(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query(f"""WITH {_EV}, m AS (SELECT user_id, min(s) AS start, max(e) AS fin, arg_max(s, (value, -s)) FILTER (event_type = 'click') AS t FROM ev GROUP BY user_id)
SELECT user_id, coalesce(t, start + greatest(0.3, (fin - start) * 0.18)) AS frame_t FROM m""")
def argmax_frame(spark, d):
    """Time of the heaviest sample, else 18 % into the range."""
    ev = intervals_of_events(spark, d)
    clips = ev.groupBy("user_id").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    samples = ev.select("user_id", F.col("s").alias("t"), F.when(F.col("event_type") == "click", 0.5).alias("cx"), F.col("value").alias("weight"))
    return camera.best_frame(samples, clips, "user_id").select("user_id", "frame_t")


@query("""WITH i AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT user_id, list_sort(list(value))[(count(*) // 2) + 1] AS med FROM i WHERE k > 1 AND value > 0 GROUP BY 1),
f AS (SELECT i.*, coalesce(k > 1 AND value > greatest(20.0, med * 3.0), false) AS fl FROM i LEFT JOIN m USING (user_id))
SELECT event_id, fl AND NOT (avg(fl::INT) OVER (PARTITION BY user_id) > 0.35) AS cut FROM f""")
def cut_detection(spark, d):
    """Adaptive cut flags."""
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return camera.mark_cuts(e, "user_id", "o", "value").select("event_id", "cut")


# ---- text -----------------------------------------------------------------------

_ASCII = [(p, w) for p, w in lexicon.EN["emotion"] if "\\w" not in p and "(ha)" not in p][:7]


@query("SELECT doc_id, 1 - exp(-(" + " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w:.2f} ELSE 0.0 END" for p, w in _ASCII) + ")) AS score FROM documents")
def rule_score(spark, d):
    """F1: saturating score of matching rules."""
    return table(spark, d, "documents").select("doc_id", T.rule_score(F.col("text"), _ASCII).alias("score"))


@query(r"""WITH t AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[\s]+'), lambda x: x <> ''), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 620 THEN t ELSE regexp_replace(left(t, 372), ' [^ ]*$', '') || ' […] ' || regexp_replace(right(t, 217), '^[^ ]* ', '') END AS excerpt FROM t""")
def text_excerpt(spark, d):
    """head and tail of a long text at word edges."""
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("""WITH t AS (SELECT o_orderkey, floor(greatest(0.0, o_totalprice / 10))::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INT, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS tc FROM t""")
def fmt_ts(spark, d):
    """time codes."""
    return table(spark, d, "orders").select("o_orderkey", T.fmt_ts(F.col("o_totalprice") / 10).alias("tc"))


@query("SELECT p_partkey, upper('&H' || '00' || substr(c, 5, 2) || substr(c, 3, 2) || substr(c, 1, 2)) AS ass FROM (SELECT p_partkey, lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') AS c FROM part)")
def hex_to_ass(spark, d):
    """colours in the subtitle format's order."""
    p = table(spark, d, "part")
    return p.select("p_partkey", T.hex_to_ass(F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))).alias("ass"))


@query(r"SELECT p_partkey, CASE WHEN s = '' THEN 'clips' ELSE s END AS stem FROM (SELECT p_partkey, left(replace(trim(regexp_replace(p_name || ' #' || p_brand || '!', '[^\w\s.-]', '', 'g')), ' ', '_'), 60) AS s FROM part)")
def safe_stem(spark, d):
    """file-name stems."""
    return table(spark, d, "part").select("p_partkey", T.safe_stem(F.concat("p_name", F.lit(" #"), "p_brand", F.lit("!"))).alias("stem"))


_SCORES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 2 AS hook, l_extendedprice % 30 AS payoff, l_discount * 200 AS emotion, l_tax * 200 AS curiosity, l_quantity % 11 AS standalone, l_extendedprice % 11 AS editability, l_shipdate FROM lineitem)"


def _scores(spark, d):
    li = table(spark, d, "lineitem")
    c = {"hook": F.col("l_quantity") / 2, "payoff": F.col("l_extendedprice") % 30, "emotion": F.col("l_discount") * 200, "curiosity": F.col("l_tax") * 200, "standalone": F.col("l_quantity") % 11, "editability": F.col("l_extendedprice") % 11}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[v.alias(k) for k, v in c.items()], "l_returnflag"), {k: F.col(k) for k in c}


_OVERALL = " + ".join(f"least({cap:.1f}, greatest(0.0, {k})) / {cap:.1f} * {cap:.1f}" for k, cap in scoring.CATEGORY_MAX.items())


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, ({_OVERALL}) * 100.0 / 100.0 AS overall FROM {_SCORES}")
def compute_overall(spark, d):
    """F8: weighted total of clamped category values."""
    rows, c = _scores(spark, d)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scoring.overall(c).alias("overall"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, least(100.0, hook / 25 * 100 * 0.30 + payoff / 25 * 100 * 0.20 + emotion / 15 * 100 * 0.28 + curiosity / 15 * 100 * 0.22
 + CASE l_returnflag WHEN 'A' THEN 12.0 WHEN 'N' THEN 4.0 ELSE 0.0 END) AS virality FROM (SELECT s.*, l_returnflag FROM {_SCORES.replace('l_shipdate', 'l_returnflag')} s)""")
def virality(spark, d):
    """virality with a bonus by type."""
    rows, c = _scores(spark, d)
    kind = F.when(F.col("l_returnflag") == "A", "controversial").when(F.col("l_returnflag") == "N", "funny").otherwise("story")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scoring.virality(c, kind).alias("virality"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * (1.0 - 0.15) + l_discount * 1000 * 0.15 AS blended FROM lineitem")
def blend(spark, d):
    """blend of two scores."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scoring.blend(F.col("l_quantity"), F.col("l_discount") * 1000, 0.15).alias("blended"))


_ALIAS_SQL = "CASE WHEN t IN (" + ", ".join(f"'{x}'" for x in scoring.CLIP_TYPES) + ") THEN t " + " ".join(f"WHEN contains(t, '{a}') THEN '{o}'" for a, o in scoring.TYPE_ALIASES.items()) + " ELSE 'other' END"


@query(f"SELECT p_partkey, {_ALIAS_SQL} AS clip_type FROM (SELECT p_partkey, replace(replace(lower(trim(CASE p_size % 6 WHEN 0 THEN 'Hot Take' WHEN 1 THEN 'practical-advice' WHEN 2 THEN p_name WHEN 3 THEN 'a big Twist' WHEN 4 THEN 'Funny' ELSE 'tips & joke' END)), ' ', '_'), '-', '_') AS t FROM part)")
def normalise_type(spark, d):
    """clip types from free text."""
    k = F.col("p_size") % 6
    v = F.when(k == 0, "Hot Take").when(k == 1, "practical-advice").when(k == 2, F.col("p_name")).when(k == 3, "a big Twist").when(k == 4, "Funny").otherwise("tips & joke")
    return table(spark, d, "part").select("p_partkey", scoring.normalise_type(v).alias("clip_type"))


@query("SELECT c_custkey, TRY_CAST(regexp_replace(replace(c_acctbal::VARCHAR || '/25', '.', ','), ',', '.', 'g').regexp_replace('[^0-9.\\-]', '', 'g') AS DOUBLE) AS value FROM customer")
def as_number(spark, d):
    """Numbers out of model answers."""
    v = F.concat(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")), F.lit("/25"))
    return table(spark, d, "customer").select("c_custkey", T.as_number(v).alias("value"))


@query("SELECT width, size, greatest(8, floor(greatest(1, width - 2 * m) / greatest(1.0, size * 0.58)))::INT AS chars FROM (SELECT DISTINCT 320 + p_size * 32 AS width, 12 + p_size AS size, p_size AS m FROM part)")
def chars_per_line(spark, d):
    """characters that fit a line."""
    p = table(spark, d, "part").select((320 + F.col("p_size") * 32).alias("width"), (12 + F.col("p_size")).alias("size"), F.col("p_size").alias("m")).distinct()
    return p.select("width", "size", T.chars_per_line(F.col("width"), F.col("size"), F.col("m")).alias("chars"))


# ---- transcripts ----------------------------------------------------------------

_TURNS = """n AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::DOUBLE * 0.4 AS n FROM conversations),
seg AS (SELECT conv_id, turn, text, sum(n + 1.5) OVER w - 1.5 - n AS s, sum(n + 1.5) OVER w - 1.5 AS e FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_TURNS} SELECT conv_id::VARCHAR AS transcript_id, turn::INT AS seg_idx, s AS start, e AS \"end\", greatest(0.0, s - coalesce(lag(e) OVER w, 0.0)) AS pause_before, greatest(0.0, coalesce(lead(s) OVER w - e, 2.0)) AS pause_after FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def pause_fields(spark, d):
    """Pauses beside each turn."""
    s = TR.segments_from_conversations(table(spark, d, "conversations"))
    return segment.pauses(s, "transcript_id", "seg_idx").select("transcript_id", "seg_idx", "start", "end", "pause_before", "pause_after")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOPWORDS))


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL]{{3,}}'), lambda x: NOT list_contains([{_STOP}], x))) AS k FROM conversations),
r AS (SELECT conv_id, turn, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
 list_distinct(flatten(coalesce(list(k) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []))) AS l, list_distinct(flatten(coalesce(list(k) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), []))) AS r FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN i >= 2 AND i < n - 2 AND least(len(l), len(r)) > 0 THEN 1.0 - len(list_intersect(l, r)) / least(len(l), len(r))::DOUBLE ELSE 0.0 END AS shift FROM r""")
def topic_shift(spark, d):
    """Lexical cohesion of two turns before and from each turn."""
    return segment.topic_shift(table(spark, d, "conversations"), "conv_id", "turn", window=2, normalise=False).select("conv_id", "turn", "shift")


@query(f"WITH {_TURNS} SELECT a.conv_id::VARCHAR AS transcript_id, a.turn::INT AS i, b.turn::INT AS j, b.e - a.s AS span FROM seg a JOIN seg b ON a.conv_id = b.conv_id AND b.turn >= a.turn AND b.e - a.s BETWEEN 20.0 AND 90.0")
def windows_in_band(spark, d):
    """All windows of turns of 20 to 90 seconds."""
    s = TR.segments_from_conversations(table(spark, d, "conversations"))
    return intervals.spans_in_band(s, "transcript_id", "seg_idx", "start", "end", 20.0, 90.0)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(len(ws))) AS k, ws FROM w)
SELECT doc_id::VARCHAR AS transcript_id, k::INT AS pos, greatest(k * 0.4::DOUBLE, 10.1::DOUBLE) AS start, least((k + 1) * 0.4::DOUBLE, 20.3::DOUBLE) AS "end", ws[k + 1] AS text FROM x WHERE (k + 1) * 0.4::DOUBLE > 10.1::DOUBLE AND k * 0.4::DOUBLE < 20.3::DOUBLE""")
def words_in_range(spark, d):
    """Evenly spread words that overlap 10.1-20.3 s, cut to it."""
    return intervals.words_between(_documents(spark, d), 10.1, 20.3)


@query(f"""WITH {_EV}, b AS (SELECT user_id, min(s) AS s0 FROM ev GROUP BY 1), c AS (SELECT ev.*, floor((s - s0) / 86400)::INT AS block FROM ev JOIN b USING (user_id)),
r AS (SELECT user_id, block, event_id, row_number() OVER (PARTITION BY user_id, block ORDER BY value DESC, event_id) AS rank FROM c) SELECT user_id, block, event_id, rank::INT AS rank FROM r WHERE rank <= 6""")
def hotspots_topk(spark, d):
    """The six best candidates inside each day-long block of a user."""
    ev = intervals_of_events(spark, d)
    day = F.floor((F.col("s") - F.min("s").over(W.partitionBy("user_id"))) / 86400).cast("int")
    return rank.top_k(ev.withColumn("block", day), ["user_id", "block"], [F.desc("value"), "event_id"], 6).select("user_id", "block", "event_id", "rank")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderkey % 97 AS payoff, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
l AS (SELECT *, n > 2 AND r > 1 AND row_number() OVER (PARTITION BY o_custkey ORDER BY (r = 1)::INT, payoff DESC, o_totalprice DESC, o_orderkey) = 1 AS last FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (r = 1 OR last)::INT, r) AS m FROM l)
SELECT o_custkey, o_orderkey, (CASE WHEN n <= 2 THEN r WHEN r = 1 THEN 1 WHEN last THEN n WHEN m <= ceil((n - 2) / 2.0) THEN 2 * m ELSE 2 * (n - 2 - m + 1) + 1 END)::BIGINT AS position FROM m""")
def retention_zigzag(spark, d):
    """T6 before swaps: best first, highest payoff last, the rest alternating."""
    o = table(spark, d, "orders").withColumn("payoff", F.col("o_orderkey") % 97)
    return rank.zigzag(o, "o_custkey", "o_totalprice", "payoff", "o_orderkey").select("o_custkey", "o_orderkey", "position")


@query(f"""WITH {_EV}, c AS (SELECT user_id, date_trunc('day', to_timestamp(s))::VARCHAR AS dy, min(s) AS fs, max(e) AS fe FROM ev GROUP BY ALL)
SELECT user_id, count(*) AS spans, sum(fe - fs) AS kept FROM c GROUP BY user_id""")
def total_duration(spark, d):
    """Total length and number of spans."""
    ev = intervals_of_events(spark, d).withColumn("dy", F.floor(F.col("s") / 86400))
    c = ev.groupBy("user_id", "dy").agg(F.min("s").alias("fs"), F.max("e").alias("fe"))
    return intervals.total_duration(c, "user_id", "fs", "fe")


# ---- order-dependent operators: SQL where a recursive query can say it, else tested against brute force ----


def _documents(spark, d):
    """Documents with their words parted as the SQL parts them."""
    return TR.from_documents(table(spark, d, "documents"), T.SQL)


#: What the steps after that need to know of it.
_SQL_WORDS = segment.Options(white=T.SQL)


def _ranked(transcripts) -> DataFrame:
    """Clips of the documents that have an id: the SQL joins by it."""
    return analyze.clips(transcripts.where("transcript_id is not null"), {"white": T.SQL})


def _conversations(spark, d):
    return TR.flatten(TR.segments_from_conversations(table(spark, d, "conversations")))


@query(folds.ANALYZE_DOCUMENTS)
def analyze_documents(spark, d):
    """The whole offline path: ranked clips of every document."""
    return _ranked(_documents(spark, d))


@query(folds.ANALYZE_CONVERSATIONS)
def analyze_conversations(spark, d):
    return analyze.clips(_conversations(spark, d), {"min_duration": 5.0, "max_duration": 60.0})


@query(folds.SENTENCES)
def sentences(spark, d):
    """Sentences of conversations, with pauses."""
    return segment.explode(segment.build(_conversations(spark, d)))


@query(folds.SENTENCES_DOCUMENTS)
def sentences_documents(spark, d):
    return segment.explode(segment.build(_documents(spark, d), _SQL_WORDS))


@query(folds.SIGNAL_PROFILES)
def signal_profiles(spark, d):
    """signal scores and tags of each sentence, by language."""
    return windows.profile_rows(_documents(spark, d), _SQL_WORDS)


@query(folds.WINDOW_SCORES)
def window_scores(spark, d):
    """Every window of the band with its score."""
    return windows.windows(analyze.ready(_documents(spark, d), T.SQL), all_windows=True, white=T.SQL).drop("clip_type")


@query(folds.NMS)
def nms(spark, d):
    """Windows that survive greedy suppression."""
    return windows.windows(analyze.ready(_documents(spark, d), T.SQL), white=T.SQL)


def _joined(spark, d) -> DataFrame:
    """Rows of words of all conversations as one transcript, each at its number times the longest one's time and two seconds."""
    s = TR.segments_from_conversations(table(spark, d, "conversations"))
    slot = s.agg((F.ceil(F.max("end")) + 2).cast("double").alias("z"))  # one row
    each = TR.flatten(s).select(F.col("transcript_id").cast("long").alias("conv"), "language", F.posexplode("words").alias("k", "w")).crossJoin(F.broadcast(slot))
    at = lambda c: (F.col("conv") * F.col("z") + F.col(f"w.{c}")).alias(c)
    return each.select(F.lit("all").alias("transcript_id"), "language", at("start"), at("end"), F.col("w.text").alias("text"), "conv", "k")


@query(folds.NMS_LONG)
def nms_long(spark, d):
    """Suppressed windows of one transcript that no task holds whole."""
    found = long.windows(_joined(spark, d), ["conv", "k"])
    return found.withColumns({c: F.col(c).cast("int") for c in ("start_idx", "end_idx")})


@query(folds.PHRASES_LONG)
def phrases_long(spark, d):
    """Caption phrases of one transcript that no task holds whole."""
    tables = shared.Tables(spark)
    p = long.pieces(long.with_positions(_joined(spark, d), ["conv", "k"], tables), long.Phrases(), tables)
    return p.select("transcript_id", F.col("idx").alias("phrase"), "start", "end", "n_words", "text")


def _order_pool(spark, d) -> DataFrame:
    """Orders of a customer as clips of five-second sentences."""
    k, i = F.col("o_orderkey"), F.col("o_orderkey") % 60
    j = i + 3 + k % 11
    number = lambda c: c.cast("double")
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("customer"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("pos"), i.alias("start_idx"), j.alias("end_idx"), (i * 5.0).alias("start"), ((j + 1) * 5.0).alias("end"),
        (k % 250 / 10.0).alias("hook"), (k % 90 / 4.0).alias("payoff"), (k * 7 % 1000 / 10.0).alias("overall"), number(k % 77).alias("heuristic"), (k % 10 / 10.0).alias("confidence"), F.col("o_orderpriority").alias("clip_type"), F.lit("heuristic").alias("source"), F.lit(1).alias("merged_from"),
    )


@query(folds.DEDUPE_MERGE)
def dedupe_merge(spark, d):
    """Overlapping clips of a pool merged, best first."""
    return rank.dedupe_rows(_order_pool(spark, d), "customer")


@query(folds.MMR)
def mmr(spark, d):
    """A varied set of five from each pool."""
    p = _order_pool(spark, d).select("customer", "pos", "start", "end", "overall", "clip_type").withColumn("duration", F.lit(400.0))
    return rank.mmr_rows(p, "customer", 5).drop("duration")


@query(folds.FIT_TRIM)
def fit_trim(spark, d):
    """spans from each sentence of conversations, fitted to 8 to 30 seconds and trimmed at the edges."""
    b = segment.build(_conversations(spark, d))
    spans = b.withColumn("spans", F.transform("sentences", lambda s: F.struct(s["idx"].alias("start_idx"), (s["idx"] + s["idx"] % 4).alias("end_idx"))))
    return rank.fit_rows(spans, "spans", 8.0, 30.0)


@query(folds.BLOCKS)
def blocks(spark, d):
    """Overlapping blocks."""
    return segment.block_rows(segment.build(_documents(spark, d), _SQL_WORDS))


@query(folds.PHRASES)
def phrases(spark, d):
    """Caption phrases."""
    return captions.phrases(_documents(spark, d))


@query(folds.CAPTION_EVENTS)
def caption_events(spark, d):
    """When each word of a caption lights up."""
    return captions.event_rows(_conversations(spark, d))


@query(folds.KEEP_SPANS)
def keep_spans(spark, d):
    """spans to keep after cutting fillers and long pauses, each conversation whole."""
    c = _conversations(spark, d)
    words = c.select(F.col("transcript_id").alias("clip_id"), F.explode("words").alias("w")).select("clip_id", "w.start", "w.end", "w.text")
    clips = c.select(F.col("transcript_id").alias("clip_id"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return trimming.keep_spans(words, clips)


@query(folds.KEEP_SPANS)
def keep_spans_sql(spark, d):
    """F29 from SQL text: the table function over each conversation's words."""
    register.register(spark)
    words = _conversations(spark, d).select(F.col("transcript_id").alias("clip_id"), F.lit(0.0).alias("clip_start"), F.col("duration").alias("clip_end"), F.explode_outer("words").alias("w")).select("clip_id", "clip_start", "clip_end", "w.start", "w.end", "w.text")
    return spark.sql("SELECT clip_id, start, end FROM keep_spans(TABLE({words}) PARTITION BY clip_id ORDER BY (start, end))", words=words)


def _samples(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("transcript_id"), seconds(F.col("ts")).alias("s"), "event_type", "value", "event_id")
    w = W.partitionBy("transcript_id")
    e = e.withColumn("t", (F.col("s") - F.min("s").over(w)) / 86400.0)
    e = e.withColumn("cx", F.when(F.col("event_type") != "signup", F.least(F.lit(1.0), F.abs("value") / 100.0)))
    return camera.mark_cuts(e.withColumn("o", F.struct("t", "event_id")), "transcript_id", "o", "value").select("transcript_id", "t", "cx", "cut")


@query(folds.CAMERA_PATH)
def camera_path(spark, d):
    """Camera path segments."""
    s = _samples(spark, d)
    return camera.paths(s, s.groupBy("transcript_id").agg(F.max("t").alias("duration")))


@query(folds.RETENTION_ORDER)
def retention_order(spark, d):
    """T6 with swaps."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_orderkey") % 97).cast("double").alias("payoff"))
    return rank.retention(o, "o_custkey", "o_totalprice", "payoff", "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderkey", "position")


def _reported(spark, d) -> DataFrame:
    return _ranked(_documents(spark, d)).withColumn("reason", F.lit(""))


@query(folds.EXPORT_CSV)
def export_csv(spark, d):
    """K2: the CSV export's rows."""
    return exports.csv_rows(_reported(spark, d))


@query(folds.EXPORT_JSON)
def export_json(spark, d):
    """K1: one JSON document a transcript."""
    return exports.json_rows(_reported(spark, d))


@query(folds.EXPORT_TEXT)
def export_text(spark, d):
    """K3: text reports."""
    return exports.text_rows(_reported(spark, d), T.SQL)


@query(folds.EXPORT_PLAN)
def export_plan(spark, d):
    """Cut commands of every clip and format."""
    t = _documents(spark, d)
    p = exports.plan_clips(_ranked(t), t.select("transcript_id", "duration"), ("16:9", "9:16"), white=T.SQL)
    return p.select("transcript_id", "rank", "format", "cut_start", "cut_end", "file", "stream_copy", F.array_join(exports.cut_command(F.lit("in.mp4"), F.col("cut_start"), F.col("cut_end"), F.col("file"), F.col("stream_copy")), " ").alias("command"))


@query(folds.COMPILATION_PLAN)
def compilation_plan(spark, d):
    """Spans of a compilation with running music offsets."""
    return exports.plan_compilation(_ranked(_documents(spark, d)), "transcript_id", "rank").select("transcript_id", "rank", "cut_start", "cut_end", "music_offset")


@query()
def subtitles(spark, d):
    """K8: a subtitle file for each clip."""
    t = _documents(spark, d)
    c = _ranked(t).join(t.select("transcript_id", "words"), "transcript_id")
    w = F.filter("words", lambda x: (x["end"] > F.col("start")) & (x["start"] < F.col("end")))
    return captions.subtitles(c.withColumn("words", w))


_SOUND = """i AS (SELECT user_id, (floor(abs(value) * 37.0::DOUBLE))::BIGINT % 20000 * CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS amp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, k, k * 0.25::DOUBLE AS s, k * 0.25::DOUBLE + 0.625 AS e, least(250 * n, 250 * k + 625) - 250 * k AS frames, 250 * amp * amp + coalesce(250 * (lead(amp) OVER w) * (lead(amp) OVER w), 0) + coalesce(125 * (lead(amp, 2) OVER w) * (lead(amp, 2) OVER w), 0) AS energy FROM i WINDOW w AS (PARTITION BY user_id ORDER BY k))"""


def _sound(spark, d) -> tuple[DataFrame, DataFrame]:
    """A WAV file for each user, a quarter second of its own loudness for each event, written to the shared folder, and a gap after every third event."""
    e = table(spark, d, "events")
    loud = (F.floor(F.abs("value") * 37.0).cast("long") % 20000 * F.when(F.col("event_type") == "view", 0).otherwise(1)).cast("int")
    each = F.flatten(F.flatten(F.transform("l", lambda x: F.array_repeat(F.array((-x["loud"]).cast("short"), x["loud"].cast("short")), 125))))
    users = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", loud.alias("loud")))).alias("l"))
    folder = f"{shared.shared_dir(spark)}/sound-{uuid.uuid4().hex}"
    audio.write(users.select(F.col("user_id").alias("name"), F.lit(1000).alias("rate"), each.alias("samples")), folder)
    spans = audio.read(spark, folder, 1500)
    files = spans.groupBy("path").agg(F.first("total").alias("total"))
    gaps = files.select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / 250).cast("int"), F.lit(3))).alias("k"))
    return spans, gaps.select("path", (F.col("k") * F.lit(0.25)).alias("start"), (F.col("k") * F.lit(0.25) + 0.625).alias("end"))


@query(f"""WITH {_SOUND}, l AS (SELECT user_id, s, e, CASE WHEN energy = 0 THEN -180.0 ELSE 20 * log10(sqrt(energy / frames::DOUBLE) / 32768.0) END AS db FROM g WHERE k % 3 = 0)
SELECT user_id, s AS gap_start, e AS gap_end, db FROM l WHERE db > -38.0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s) <= 40""")
def loud_gaps(spark, d):
    """Gaps of WAV files that are loud enough to hear again, levels from byte ranges of the files."""
    spans, gaps = _sound(spark, d)
    user = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")
    found = audio.levels(spans, gaps, 1500).select(user.alias("user_id"), F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), "db")
    return intervals.louder_gaps(found.select("user_id", "gap_start", "gap_end"), found, ["user_id", "gap_start", "gap_end"])


class _Script:
    """Answers by rule from what a prompt shows: the first lines of a block, one line less at the end, the finalists by number."""

    def complete(self, system, user, schema):
        at = [int(x) for x in re.findall(r"^\[(\d+)\]", user, re.M)]
        if '"candidates"' in user:
            picks = [at[k] for k in range(0, len(at), 12)]
            return json.dumps({"candidates": [{"start_index": k, "end_index": k + 4, "hook": k % 26, "payoff": k % 24, "emotion": k % 15, "curiosity": 7, "standalone": 6, "editability": 5, "clip_type": ("story", "hot take", "funny")[k % 3], "confidence": 0.8, "suggested_title": f"Part {k}"} for k in picks]})
        if "Move its bounds" in user:
            a, z = (int(x) for x in re.search(r"from (\d+) to (\d+)", user).groups())
            return json.dumps({"start_index": a, "end_index": max(a, z - 1), "title": f"From line {a}"})
        return json.dumps({"ranked": [{"id": k, "final_score": 100 - 3 * n, "title": "", "verdict": f"place {n}", "clip_type": "", "absorbed": []} for n, k in enumerate(at)]})


@query()
def model_clips(spark, d):
    """Clips of conversations with a scripted model in its three passes, replies through the ledger."""
    return analyze.with_model(_conversations(spark, d), _Script(), {"min_duration": 5.0, "max_duration": 60.0, "wait": 0.0})


@query(folds.BLOCK_PROMPTS)
def block_prompts(spark, d):
    """The prompt of each block, as a hash."""
    b = segment.build(_documents(spark, d), _SQL_WORDS)
    return models.block_prompts(segment.block_rows(b), b, 20.0, 90.0).select("transcript_id", "block", "start_idx", "end_idx", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(folds.SPEECH_CHECK)
def speech_check(spark, d):
    """Whether a transcript holds enough speech."""
    return segment.require_speech(segment.explode(segment.build(_documents(spark, d), _SQL_WORDS)))


# ---- predicates and scalars over the lines and words of conversations -----------------------

#: Every turn whole, and its sentences' worth of lines: what lies between marks.
_TURN_LINES = r"""l AS (SELECT conv_id, turn, k, line, (conv_id + turn + k) % 10 / 10.0 AS ns, -((conv_id + turn + k) % 7) / 5.0 AS lp FROM (
  SELECT conv_id, turn, unnest(x) AS line, unnest(range(len(x))) AS k FROM (SELECT conv_id, turn, list_prepend(coalesce(text, ''), regexp_split_to_array(coalesce(text, ''), '[.!?,;:]')) AS x FROM conversations)))"""
_TURN_TOKENS = r"l AS (SELECT conv_id, turn, unnest(x) AS line, unnest(range(len(x))) AS k FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS x FROM conversations))"


def _lines(spark, d) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    all_ = F.concat(F.array(text), F.split(text, "[.!?,;:]"))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(all_).alias("k", "line"))
    n = F.col("conv_id") + F.col("turn") + F.col("k")
    return c.select("conv_id", "turn", F.col("k").cast("long").alias("k"), "line", (n % 10 / 10.0).alias("ns"), (-(n % 7) / 5.0).alias("lp"))


def _tokens(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("k", "line"))
    return c.withColumn("k", F.col("k").cast("long"))


def _any(rules) -> str:
    return "(" + " OR ".join("regexp_matches(line, '(?i)" + p.replace("'", "''") + "')" for p, _ in rules) + ")"


def _among(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_N_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"


@query(f"WITH {_TURN_LINES} SELECT conv_id, turn, k, {_any(lexicon.FILLER_ONLY)} AND {_N_WORDS.format('line')} <= 5 AS filler, {_any(lexicon.TRANSITION_OUT)} AS transition FROM l")
def line_kinds(spark, d):
    """Bare acknowledgements and lines that change the subject."""
    return _lines(spark, d).select("conv_id", "turn", "k", T.is_filler(F.col("line")).alias("filler"), T.is_transition(F.col("line")).alias("transition"))


@query(f"WITH {_TURN_TOKENS} SELECT conv_id, turn, k, lower(regexp_replace(line, '^[ .,!?…-]+|[ .,!?…-]+$', '', 'g')) IN ({_among(T.FILLER_WORDS)}) AS filler_word FROM l")
def filler_words(spark, d):
    """P5: words that only fill a pause."""
    return _tokens(spark, d).select("conv_id", "turn", "k", T.is_filler_word(F.col("line")).alias("filler_word"))


@query(rf"""WITH {_TURN_LINES}, n AS (SELECT *, trim(line) AS t, trim(regexp_replace(lower(line), '[^\pL\pN\s]', '', 'g')) AS n FROM l)
SELECT conv_id, turn, k, line FROM n WHERE NOT (t = '' OR (ns >= 0.6 AND lp < -0.5 AND {_N_WORDS.format('n')} <= 3) OR regexp_full_match(t, '[\[(♪].*[\])♪]') OR t = '♪' OR (ns >= 0.5 AND n IN ({_among(T.HALLUCINATIONS)})))""")
def hallucination_filter(spark, d):
    """Lines left without what a recogniser makes up over silence."""
    return _lines(spark, d).where(~T.is_hallucination(F.col("line"), F.col("ns"), F.col("lp"))).select("conv_id", "turn", "k", "line")


@query(f"""WITH {_TURN_TOKENS} SELECT conv_id, turn, k, translate(upper(replace(regexp_replace(trim(line), '[,.!?;:"“”«»]+$', '', 'g'), 'ß', 'SS')), '{{}}', '()') AS caption FROM l""")
def caption_text(spark, d):
    """the words of a caption, upper case without closing punctuation."""
    return _tokens(spark, d).select("conv_id", "turn", "k", T.caption_text(F.col("line")).alias("caption"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey)::INT AS rank FROM lineitem QUALIFY rank <= 3")
def top_k_per_group(spark, d):
    """The best three of each group, ranked."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rank.top_k(rows, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"], 3)


@query("""SELECT o_orderkey, greatest(0.0, s - least(0.25, 0.6 * b)) AS start, e + least(0.4, 0.6 * greatest(0.0, a)) AS "end" FROM (
SELECT o_orderkey, (o_orderkey % 50) / 8.0 AS s, (o_orderkey % 50) / 8.0 + 20 AS e, (o_custkey % 9) / 10.0 AS b, (o_custkey % 7 - 1) / 5.0 AS a FROM orders)""")
def padding(spark, d):
    """a span moved outwards into the pauses around it."""
    o = table(spark, d, "orders")
    s = F.col("o_orderkey") % 50 / 8.0
    return o.select("o_orderkey", scoring.padding(s, s + 20, F.col("o_custkey") % 9 / 10.0, (F.col("o_custkey") % 7 - 1) / 5.0).alias("p")).select("o_orderkey", "p.start", "p.end")


@query("SELECT s_suppkey, CASE WHEN s < 20 THEN 'too_short' WHEN s < 60 THEN 'few_clips' ELSE 'ok' END AS verdict FROM (SELECT s_suppkey, s_acctbal / 100 AS s FROM supplier)")
def duration_guard(spark, d):
    """P10: media too short for one clip, or for several."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("duration"))
    return segment.duration_guard(s).select("s_suppkey", "verdict")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE coalesce((props->>'$.k')::INT, 1) END AS k, user_id::INT AS u, CASE WHEN event_type = 'view' THEN NULL ELSE (props->>'$.x')::INT END AS x FROM events""")
def merge_maps(spark, d):
    """Each event's properties over defaults, the right one wins; a view's are left out."""
    left = F.create_map(F.lit("k"), F.lit(1), F.lit("u"), F.col("user_id").cast("int"))
    none = F.create_map().cast("map<string,int>")
    right = F.when(F.col("event_type") == "view", none).otherwise(F.coalesce(F.from_json("props", "map<string,int>"), none))
    m = table(spark, d, "events").select("event_id", T.merge_maps(left, right).alias("m"))
    return m.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "kux"])


@query("""SELECT p_partkey, (p_size * 10.5)::DOUBLE AS duration, 320 + p_size AS width, 240 + p_size AS height, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 30000 / 1001.0 END AS fps,
  p_partkey * 1000 AS size_bytes, 'h264' AS vcodec, CASE WHEN p_partkey % 2 = 0 THEN 'aac' ELSE '' END AS acodec, p_partkey % 2 = 0 AS has_audio, 'v' || p_partkey || '.mp4' AS filename FROM part""")
def media_probe(spark, d):
    """One row of media columns for each probe document."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    cover = F.lit('{"codec_type":"video","codec_name":"mjpeg","width":9,"height":9,"disposition":{"attached_pic":1}},')
    rate = F.when(F.col("p_partkey") % 4 == 0, F.lit("0/0")).otherwise(F.lit("30000/1001"))
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":'), (s + 320).cast("string"), F.lit(',"height":'), (s + 240).cast("string"), F.lit(',"avg_frame_rate":"'), rate, F.lit('","duration":"'), (s * 10.5).cast("string"), F.lit('"}'))
    audio = F.when(F.col("p_partkey") % 2 == 0, F.lit(',{"codec_type":"audio","codec_name":"aac"}')).otherwise(F.lit(""))
    form = F.concat(F.lit('],"format":{"filename":"/in/v'), k, F.lit('.mp4","size":"'), (F.col("p_partkey") * 1000).cast("string"), F.lit('","duration":"'), (s * 10).cast("string"), F.lit('"}}'))
    raw = table(spark, d, "part").select("p_partkey", F.concat(F.lit('{"streams":['), cover, video, audio, form).alias("probe"))
    return media.parse_probe(raw).drop("probe")


_DAMAGED = """SELECT conv_id, turn, text, (conv_id + turn) % 5 AS kind FROM conversations"""


@query(f"""SELECT conv_id, turn, CASE kind WHEN 4 THEN 0 ELSE 2 END AS n, CASE WHEN kind < 4 THEN turn::INT END AS first, CASE WHEN kind < 4 THEN coalesce(text, '') END AS title FROM ({_DAMAGED})""")
def json_repair(spark, d):
    """Objects that hold a turn's whole text, from replies that are fenced, cut off, commented or no JSON at all."""
    c = table(spark, d, "conversations")
    of = lambda at, title: F.to_json(F.struct(at.alias("start_index"), title.alias("title")))
    a, b = of(F.col("turn"), F.coalesce("text", F.lit(""))), of(F.lit(7), F.lit("a \"quoted\" one"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"candidates": ['), a, F.lit(", "), b, F.lit("]}\n```")))
        .when(kind == 1, F.concat(F.lit('{"candidates":['), a, F.lit(","), b, F.lit(',{"start_in')))
        .when(kind == 2, F.concat(F.lit('Sure: {"candidates": ['), a, F.lit(", "), b, F.lit(",],}")))
        .when(kind == 3, F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")))
        .otherwise(F.lit("I cannot help with that."))
    )
    r = jsonrepair.repair(c.select("conv_id", "turn", reply.alias("reply")), "reply", "candidates").withColumn("f", F.get("items", F.lit(0)))
    return r.select("conv_id", "turn", F.size("items").alias("n"), F.get_json_object("f", "$.start_index").cast("int").alias("first"), F.get_json_object("f", "$.title").alias("title"))


@query("""WITH c AS (SELECT o_custkey::VARCHAR AS video_hash, o_orderkey AS rank, o_orderpriority AS clip_type, o_totalprice AS overall FROM orders),
e AS (SELECT o_custkey::VARCHAR AS video_hash, o_orderkey + o_orderkey % 2 AS rank, CASE WHEN o_orderkey % 3 = 0 THEN 'story' END AS clip_type, o_orderkey % 100 AS views FROM orders)
SELECT video_hash, rank, coalesce(e.clip_type, c.clip_type) AS clip_type, views, overall FROM e LEFT JOIN c USING (video_hash, rank)""")
def performance_log(spark, d):
    """Requests filled from the snapshots of their clips."""
    o = table(spark, d, "orders")
    v = F.col("o_custkey").cast("string").alias("video_hash")
    clips = o.select(v, F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("clip_type"), F.col("o_totalprice").alias("overall"))
    entries = o.select(v, (F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("rank"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("story")).alias("clip_type"), (F.col("o_orderkey") % 100).alias("views"))
    return insights.log(clips, entries).select("video_hash", "rank", "clip_type", "views", "overall")


@query("""WITH s AS (SELECT conv_id::VARCHAR AS transcript_id, turn::INT AS idx, (turn + 1) * 7.0 AS e FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
p AS (SELECT DISTINCT conv_id::VARCHAR AS transcript_id, (x * 9.0)::DOUBLE AS t FROM conversations, range(8) r(x))
SELECT p.transcript_id, t, coalesce(min(idx) FILTER (e >= t), max(idx)) AS idx FROM p JOIN s USING (transcript_id) GROUP BY ALL""")
def sentence_at(spark, d):
    """The sentence at a time, or the last one."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("transcript_id"), F.col("turn").cast("int").alias("idx")).distinct()
    points = c.select("transcript_id").distinct().select("transcript_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x")).select("transcript_id", (F.col("x") * F.lit(9.0)).alias("t"))
    return segment.sentence_at(c.withColumn("end", (F.col("idx") + 1) * F.lit(7.0)), points).select("transcript_id", "t", "idx")


# ---- picks, logs and plans of whole tables -------------------------------------------


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank IN (1, 3)")
def rank_selection(spark, d):
    """Clips of chosen ranks."""
    o = rank.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 1 << 30)
    return rank.pick_ranks(o, [1, 3]).select("o_custkey", "o_orderkey", "rank")


@query("""WITH c AS (SELECT o_custkey, o_orderkey AS rank, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_orderkey % 89 END::DOUBLE AS virality, (o_orderkey % 71)::DOUBLE AS overall FROM orders)
SELECT o_custkey, rank, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(virality, 0.0), overall) DESC, rank)::INT AS place FROM c QUALIFY place <= 3""")
def compilation_pick(spark, d):
    """T5: the most viral clips, by score where there is no virality."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select("o_custkey", k.alias("rank"), F.when(k % 3 == 0, 0.0).otherwise((k % 89).cast("double")).alias("virality"), (k % 71).cast("double").alias("overall"))
    return rank.compilation_pick(c, 3, "o_custkey").select("o_custkey", "rank", "place")


@query("""WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'error' ELSE 'cancelled' END AS status, o_orderdate AS finished_at FROM orders),
o AS (SELECT id, row_number() OVER (ORDER BY finished_at, id) AS age FROM j WHERE status <> 'running')
SELECT id, status FROM j WHERE id NOT IN (SELECT id FROM o WHERE age <= (SELECT greatest(0, count(*) - 12) FROM j))""")
def prune_jobs(spark, d):
    """Jobs less the oldest finished ones beyond twelve."""
    k = F.col("o_orderkey") % 4
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "running").when(k == 1, "done").when(k == 2, "error").otherwise("cancelled").alias("status"), F.col("o_orderdate").alias("finished_at"))
    return rank.prune_jobs(j).select("id", "status")


@query("""WITH w AS (SELECT count(*) OVER (PARTITION BY user_id) AS n, min(value) OVER (PARTITION BY user_id) < max(value) OVER (PARTITION BY user_id) AS spread FROM events)
SELECT count(*) AS count, count(*) FILTER (n >= 2 AND spread) AS with_signal, 5 AS need, count(*) FILTER (n >= 2 AND spread) >= 5 AS ready FROM w""")
def readiness(spark, d):
    """Whether enough rows can be compared, over all events."""
    p = table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_hash"), F.col("value").alias("engagement"))
    return insights.readiness(p).drop("reason")


@query("""SELECT o_orderkey AS id, o_custkey::VARCHAR AS video_hash, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 25)::DOUBLE END AS hook, (o_orderkey % 1000 + 3 * (o_orderkey % 50))::DOUBLE AS engagement
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500)""")
def performance_scan(spark, d):
    """The newest rows with scores decoded (broken JSON: none) and engagement."""
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.lit('{"hook": ')).otherwise(F.concat(F.lit('{"hook": '), (k % 25).cast("string"), F.lit("}")))
    p = table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").cast("string").alias("video_hash"), raw.alias("scores"), (k % 1000).alias("views"), (k % 50).alias("likes"), F.lit(0).alias("comments"), F.lit(None).cast("long").alias("shares"), F.col("o_orderdate").alias("logged_at"))
    return insights.scan(p, 500).select("id", "video_hash", F.try_element_at("scores", F.lit("hook")).alias("hook"), "engagement")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def performance_delete(spark, d):
    """K7: the log less some ids."""
    ids = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return insights.without(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), ids)


@query(f"""WITH {_TURNS}, a AS (SELECT conv_id, turn, s, e, false AS recovered FROM seg UNION ALL SELECT conv_id, turn, greatest(0.0, e - 0.2) + 0.1, greatest(0.0, e - 0.2) + 0.9, true FROM seg WHERE turn % 2 = 0)
SELECT conv_id::VARCHAR AS transcript_id, (row_number() OVER (PARTITION BY conv_id ORDER BY s, recovered, e) - 1)::INT AS seg_idx, s AS start, e AS "end", recovered FROM a""")
def gap_fill(spark, d):
    """What is heard again in the gap after every other turn, among the turns."""
    s = TR.segments_from_conversations(table(spark, d, "conversations"))
    again = s.where("seg_idx % 2 = 0").select("transcript_id", F.lit(0.1).alias("start"), F.lit(0.9).alias("end"), F.lit("heard again after all of it").alias("text"), F.col("end").alias("gap_start"), F.lit(0.1).alias("no_speech_prob"), F.lit(-0.1).alias("avg_logprob"))
    return TR.fill_gaps(s, again).select("transcript_id", "seg_idx", "start", "end", "recovered")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice AS score, (o_orderkey % 60)::INT AS start_idx, (o_orderkey % 60 + o_orderkey % 7)::INT AS end_idx FROM orders),
b AS (SELECT o_custkey, unnest([0, 1, 2]) AS block FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_custkey::VARCHAR AS transcript_id, block, o_orderkey, row_number() OVER (PARTITION BY o_custkey, block ORDER BY score DESC, start_idx, end_idx)::INT AS rank FROM c JOIN b USING (o_custkey) WHERE start_idx >= block * 20 AND end_idx <= block * 20 + 25 QUALIFY rank <= 6""")
def hotspots(spark, d):
    """The six best candidates that lie inside each block."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    c = o.select(F.col("o_custkey").cast("string").alias("transcript_id"), k, F.col("o_totalprice").alias("score"), (k % 60).cast("int").alias("start_idx"), (k % 60 + k % 7).cast("int").alias("end_idx"))
    b = c.select("transcript_id").distinct().select("transcript_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("block"))
    return intervals.hotspots(c, b.select("transcript_id", "block", (F.col("block") * 20).alias("start_idx"), (F.col("block") * 20 + 25).alias("end_idx"))).select("transcript_id", "block", "o_orderkey", "rank")


@query("""WITH s AS (SELECT conv_id::VARCHAR AS tid, turn::INT AS idx, (turn + 1) * 7.0 AS e FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
r AS (SELECT DISTINCT conv_id::VARCHAR AS tid, (x * 11.0)::DOUBLE AS a, (x * 11.0 + 15)::DOUBLE AS b FROM conversations, range(4) t(x))
SELECT r.tid AS transcript_id, a AS start, b AS "end", coalesce(min(idx) FILTER (e >= a), max(idx)) AS start_idx, coalesce(min(idx) FILTER (e >= b), max(idx)) AS end_idx FROM r JOIN s USING (tid) GROUP BY ALL""")
def snap_range(spark, d):
    """The sentences at either end of a range."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("transcript_id"), F.col("turn").cast("int").alias("idx")).distinct()
    r = c.select("transcript_id").distinct().select("transcript_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x")).select("transcript_id", (F.col("x") * F.lit(11.0)).alias("start"), (F.col("x") * F.lit(11.0) + 15).alias("end"))
    return segment.snap_range(c.withColumn("end", (F.col("idx") + 1) * F.lit(7.0)), r).select("transcript_id", "start", "end", "start_idx", "end_idx")


@query("""SELECT p_partkey, array_to_string(['ffmpeg', '-y', '-hide_banner', '-loglevel', 'error', '-ss', printf('%.3f', p_size / 8.0), '-i', 'in.mp4', '-t', printf('%.3f', greatest(0.2, p_size / 4.0 - 1)), '-vf', 'scale=1080:1920',
 '-c:v', 'libx264', '-preset', 'veryfast', '-crf', '21', '-pix_fmt', 'yuv420p', '-c:a', 'aac', '-b:a', '192k', '-movflags', '+faststart', p_partkey || '.mp4'], ' ') AS render,
 array_to_string(['ffmpeg', '-y', '-hide_banner', '-loglevel', 'error', '-ss', printf('%.3f', p_size / 8.0), '-i', 'in.mp4', '-frames:v', '1', '-vf', 'scale=480:-2', p_partkey || '.jpg'], ' ') AS thumbnail FROM part""")
def command_plans(spark, d):
    """K9: render and thumbnail commands as argument vectors."""
    at, k = F.col("p_size") / 8.0, F.col("p_partkey").cast("string")
    render = exports.render_command(F.lit("in.mp4"), at, at + F.col("p_size") / 4.0 - 1, F.lit("scale=1080:1920"), F.concat(k, F.lit(".mp4")))
    return table(spark, d, "part").select("p_partkey", F.array_join(render, " ").alias("render"), F.array_join(exports.thumbnail_command(F.lit("in.mp4"), at, F.concat(k, F.lit(".jpg"))), " ").alias("thumbnail"))


@query(r"""SELECT conv_id, turn, len(ws)::INT AS n, CASE WHEN len(ws) > 0 THEN 0.5::DOUBLE END AS start, CASE WHEN len(ws) > 0 THEN (len(ws) - 1) + 0.75::DOUBLE END AS "end", array_to_string(ws, ' ') AS text
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM conversations)""")
def clip_words(spark, d):
    """Every turn's words as JSON, objects and triples by turns with broken items between, read back."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.words(F.coalesce("text", F.lit(""))).alias("ws"))
    quoted = lambda w: F.regexp_extract(F.to_json(F.array(w)), r"(?s)^\[(.*)\]$", 1)
    at = lambda i, more: F.concat(i.cast("string"), F.lit(more))
    thing = lambda w, i: F.concat(F.lit('{"start": '), at(i, ".5"), F.lit(', "end": '), at(i, ".75"), F.lit(', "text": '), quoted(w), F.lit('}, {"end": 2}'))
    triple = lambda w, i: F.concat(F.lit("["), at(i, ".5"), F.lit(", "), at(i, ".75"), F.lit(", "), quoted(w), F.lit('], 7, null, ["x", 1]'))
    text = F.concat(F.lit("["), F.array_join(F.transform("ws", lambda w, i: F.when(i % 2 == 0, thing(w, i)).otherwise(triple(w, i))), ", "), F.lit("]"))
    w = c.select("conv_id", "turn", TR.clip_words(text).alias("w"))
    return w.select("conv_id", "turn", F.size("w").alias("n"), F.get("w", F.lit(0))["start"].alias("start"), F.get("w", F.size("w") - 1)["end"].alias("end"), F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))
