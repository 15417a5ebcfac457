"""Transcript sources: tables of segments, and one row of words for each transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import text as T

#: Seconds a word takes where a text has no times, and the pause between turns.
WORD_SECONDS, TURN_PAUSE = 0.4, 1.5


def even_words(text, start, end):
    """The words of a text spread evenly over a span."""

    def spread(w):
        step = (end - start) / F.size(w)
        return F.transform(w, lambda x, i: F.struct((start + step * i).alias("start"), (start + step * (i + 1)).alias("end"), x.alias("text"), F.lit(1.0).alias("prob")))

    return T.let(T.words(text), spread)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the cores if they come in fewer partitions than there are cores (few or unsplittable files); else as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows


def from_documents(docs: DataFrame, white: T.White = T.UNICODE) -> DataFrame:
    """A row (transcript_id, language, duration, words) for each document: one segment, words WORD_SECONDS apart, parted at `white`."""

    def timed(w):
        return F.transform(w, lambda x, i: F.struct((i * F.lit(WORD_SECONDS)).alias("start"), ((i + 1) * F.lit(WORD_SECONDS)).alias("end"), x.alias("text"), F.lit(1.0).alias("prob")))

    text = F.coalesce(F.col("text"), F.lit(""))
    return spread(docs.select("doc_id", "lang", "text")).select(
        F.col("doc_id").cast("string").alias("transcript_id"),
        F.coalesce(T.lower(F.substring("lang", 1, 2), white), F.lit("en")).alias("language"),
        (T.word_count(text, white).cast("double") * WORD_SECONDS).alias("duration"),
        T.let(T.words(text, white), timed).alias("words"),
    )


def segments_from_conversations(conv: DataFrame) -> DataFrame:
    """A segment for each turn, TURN_PAUSE seconds after the one before."""
    from pyspark.sql import Window as W

    n = T.word_count(F.col("text")).cast("double") * WORD_SECONDS
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(n + TURN_PAUSE).over(w) - TURN_PAUSE
    return conv.select(F.col("conv_id").cast("string").alias("transcript_id"), F.lit("en").alias("language"), F.col("turn").cast("int").alias("seg_idx"), (end - n).alias("start"), end.alias("end"), "text", "role")


def flatten(segments: DataFrame) -> DataFrame:
    """One row of words, in order of start, for each transcript; blank words go; a segment without word times has its tokens spread evenly over it."""
    has_words = "words" in segments.columns
    spread = even_words(F.coalesce(F.col("text"), F.lit("")), F.col("start"), F.col("end"))
    timed = F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, F.transform("words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.trim(w["text"]).alias("text"), F.coalesce(w["prob"], F.lit(1.0)).alias("prob")))).otherwise(spread) if has_words else spread
    s = segments.select("transcript_id", "language", "seg_idx", F.col("end").alias("seg_end"), F.filter(timed, lambda w: w["text"] != "").alias("w"))
    g = s.groupBy("transcript_id").agg(F.first("language").alias("language"), F.max("seg_end").alias("duration"), F.collect_list(F.struct("seg_idx", "w")).alias("segs"))
    flat = F.flatten(F.transform(F.array_sort("segs", lambda a, b: a["seg_idx"] - b["seg_idx"]), lambda x: x["w"]))
    order = F.array_sort(F.transform(flat, lambda w, i: F.struct(w["start"].alias("start"), i.alias("i"), w.alias("w"))))
    return g.select("transcript_id", "language", "duration", F.transform(order, lambda x: x["w"]).alias("words"))


def drop_hallucinations(segments: DataFrame) -> DataFrame:
    return segments.where(~T.is_hallucination(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob")))


def read_segments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SEGMENTS).format(fmt).load(path)


def read_cached(spark: SparkSession, path: str) -> DataFrame:
    """Cached transcripts (JSON, one document a file); one without raw segments counts as a miss, a corrupt one is left out."""
    schema = "language string, duration double, raw_segments array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,text:string,prob:double>>,no_speech_prob:double,avg_logprob:double>>, _corrupt string"
    d = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    d = d.withColumn("transcript_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return d.where(F.col("_corrupt").isNull() & (F.size("raw_segments") > 0)).drop("_corrupt")


def cached_segments(cached: DataFrame) -> DataFrame:
    s = cached.select("transcript_id", "language", "duration", F.posexplode("raw_segments").alias("seg_idx", "s"))
    return s.select("transcript_id", "language", "duration", "seg_idx", "s.*")


def cache_key(model, language):
    """File name of a cached transcript: version, model and language; characters that names do not take become underscores (fixed format)."""
    return F.concat(F.lit("transcript_v2_"), F.regexp_replace(F.concat(model, F.lit("_"), F.coalesce(F.when(language != "", language), F.lit("auto"))), r"(?U)[^\w.-]", "_"), F.lit(".json"))


def read_json_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached metadata or results, one JSON document a file, by the folder they lie in; corrupt documents are left out."""
    d = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    d = d.withColumn("transcript_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return d.where(F.col("_corrupt").isNull()).drop("_corrupt")


def clip_words(words):
    """Words of a clip from JSON text, an array of {start, end, text} or [start, end, text]; items that are neither are skipped."""
    items = F.coalesce(F.from_json(words, "array<string>"), F.array().cast("array<string>"))

    def one(x):
        listed = F.from_json(x, "array<string>")
        at = lambda k, name: F.when(x.startswith("["), F.get(listed, F.lit(k))).otherwise(F.get_json_object(x, f"$.{name}"))
        return F.struct(at(0, "start").try_cast("double").alias("start"), at(1, "end").try_cast("double").alias("end"), F.when(x.startswith("["), F.get(listed, F.lit(2))).otherwise(F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).alias("text"))

    return F.filter(F.transform(items, one), lambda w: w["start"].isNotNull() & w["end"].isNotNull() & w["text"].isNotNull())


#: Lead-in of a stretch that is transcribed again (fixed value).
GAP_PAD = 0.20


def fill_gaps(segments: DataFrame, again: DataFrame) -> DataFrame:
    """segments and what was heard again in their gaps, in order of start.

    again: rows like segments with gap_start; times count from GAP_PAD before the gap, so they are shifted;
    made-up lines go.  seg_idx numbers the whole anew; `recovered` tells the two apart.
    """
    from pyspark.sql import Window as W

    at = F.greatest(F.lit(0.0), F.col("gap_start") - GAP_PAD)
    heard = drop_hallucinations(again).withColumns({"start": F.col("start") + at, "end": F.col("end") + at, "recovered": F.lit(True)}).drop("gap_start")
    both = segments.withColumn("recovered", F.lit(False)).unionByName(heard, allowMissingColumns=True)
    return both.withColumn("seg_idx", (F.row_number().over(W.partitionBy("transcript_id").orderBy("start", "recovered", "end")) - 1).cast("int"))
