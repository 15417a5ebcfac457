"""Streaming queries give what their batch versions give."""

from pyspark.sql import functions as F

from spanloom.streaming import online


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_counts_and_sessions(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = sum(r.n for r in run(online.counts(s), "counts_out", spark, "complete"))
    assert got == e.count()
    assert sum(r.n for r in run(online.sessions(s), "sessions_out", spark, "complete")) == e.count()


def test_sentences(spark, tmp_path):
    words = [("t", k * 0.5, k * 0.5 + 0.4, w) for k, w in enumerate("this is one whole sentence. here comes a second one. and then".split())]
    d = spark.createDataFrame(words, "transcript_id string, start double, end double, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "w"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "w"))
    out = [r.text for r in run(online.sentences(s, None), "sentences_out", spark)]
    assert out == ["this is one whole sentence.", "here comes a second one."]
