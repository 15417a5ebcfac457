"""Streams of events that arrive out of order give what the batch operators give on all of them."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import camera, intervals
from spanloom.streaming import ordered

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    old = spark.conf.get(ordered.STORE[0])
    spark.conf.set(*ordered.STORE)
    yield
    spark.conf.set(ordered.STORE[0], old)


def events(spark):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    s = F.unix_micros(ts) / F.lit(1e6)
    e = e.select(F.col("user_id").cast("string").alias("transcript_id"), ts.alias("ts"), s.alias("start"), (s + F.least(F.lit(3600.0), F.abs("value") * 60.0)).alias("end"), "event_id", "event_type", "value")
    return e.where("user_id < 12")


def replay(spark, rows, path, late_s=7200, files=3, flush=None):
    """A stream that reads files in turn; rows move to a later file by up to `late_s`, and a row far in the future closes it."""
    lo, hi = rows.agg(F.min("start"), F.max("start")).first()
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(late_s)).cast("double")
    part = F.least(F.lit(files - 1), F.floor((F.col("start") + jitter - lo) / ((hi - lo) / files + 1.0)))
    all_ = rows.withColumn("_f", part)
    for k in range(files):
        all_.where(F.col("_f") == k).drop("_f").coalesce(1).write.mode("append").parquet(path)
    for k in (1, 2):
        end = rows.limit(1).withColumns({"transcript_id": F.lit("end"), "ts": F.timestamp_seconds(F.lit(hi + k * 864000.0)), "start": F.lit(hi + k * 864000.0), "end": F.lit(hi + k * 864000.0)})
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()
    return spark.table(name).where("transcript_id <> 'end'").collect()


def test_gaps_equal_batch(spark, store, tmp_path):
    rows = events(spark)
    got = run(ordered.gaps(replay(spark, rows, str(tmp_path / "e")), late="3 hours"), "gaps_online", spark)
    want = intervals.gaps(rows, "transcript_id", "start", "end", 2.5).collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_smoothing_equals_batch(spark, store, tmp_path):
    rows = events(spark).withColumns({"t": F.col("start"), "cx": F.when(F.col("event_type") != "signup", F.least(F.lit(1.0), F.abs("value") / 100.0)), "cut": F.col("event_id") % 5 == 0})
    got = run(ordered.smoothed(replay(spark, rows, str(tmp_path / "s")), late="3 hours"), "smooth_online", spark)
    want = []
    by = {}
    for r in rows.orderBy("ts", "t", F.col("cx").asc_nulls_last(), "cut").collect():
        by.setdefault(r.transcript_id, []).append(r)
    for k, rs in by.items():
        if any(r.cx is not None for r in rs):
            want += [(k, r.t, x) for r, x in zip(rs, camera.smooth([r.t for r in rs], [r.cx for r in rs], [r.cut for r in rs]))]
    assert len(want) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_clipping_joins_two_streams(spark, store, tmp_path):
    rows = events(spark)
    words = rows.select("transcript_id", "ts", "start", "end", "event_id")
    ranges = rows.where("event_id % 3 = 0").select("transcript_id", F.col("ts").alias("r_ts"), F.col("start").alias("r_start"), (F.col("start") + 7200.0).alias("r_end"), F.col("event_id").alias("r_id"))
    w = replay(spark, words, str(tmp_path / "w"))
    again = replay(spark, rows.where("event_id % 3 = 0"), str(tmp_path / "r"))
    r = again.select("transcript_id", F.col("ts").alias("r_ts"), F.col("start").alias("r_start"), (F.col("start") + 7200.0).alias("r_end"), F.col("event_id").alias("r_id"))
    got = run(ordered.clip_to(w, r, "transcript_id", "1 hour", "2 hours", late="3 hours").select("transcript_id", "event_id", "r_id", "start", "end"), "clips_online", spark)
    want = intervals.clip_to(words, ranges.drop("r_ts"), "transcript_id", "r_id").select("transcript_id", "event_id", "r_id", "start", "end").collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_longer_interval_stops_the_query(spark, store, tmp_path):
    rows = events(spark)
    s = replay(spark, rows, str(tmp_path / "x"))
    r = s.select("transcript_id", F.col("ts").alias("r_ts"), F.col("start").alias("r_start"), (F.col("start") + 7201.0).alias("r_end"))
    with pytest.raises(Exception, match="longer than 2 hours"):
        run(ordered.clip_to(s.select("transcript_id", "ts", "start", "end"), r, "transcript_id", "1 hour", "2 hours"), "clips_long", spark)
