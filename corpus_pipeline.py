"""Corpus pipeline: five stages over `documents`, each on all that the one before kept, with a written table between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, mixing, pii, scratch, simhash, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become placeholders."""
    return pii.redact(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with how many of their words (repeats counted) it takes."""
    return mixing.mix(docs, mixing.n_words(F.col("text"))).where(F.col("taken") > 0)


STAGES = [("toxicity", stage_toxicity), ("near_dedup", stage_near_dedup), ("decontamination", stage_decontamination), ("pii", stage_pii), ("mixing", stage_mixing)]

#: Compression lengths and SimHash have no SQL; tests/llm compares each stage with a plain-loop version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and reread as the next one's input, and what it needed on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.run():
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = scratch.stored(docs, f"pipeline-{name}")
                scratch.release(spark, docs)
    return docs
