"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget.  Whole epochs of the source come first; the
rest of the budget is drawn without replacement: a document's key is an
exponential variate divided by its quality weight, keys are sorted within the
source, and documents are taken until the prefix sum of their sizes meets the
budget; the document at the border is taken in part.

The sort is distributed: keys fall into range buckets by a monotone map (the
distribution of the keys of the source, given its weights), bucket
sums (a few numbers for each source) give every bucket its starting prefix, and
only inside a bucket are rows sorted.  So a source with a third of all rows is
many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm import kern, scratch

WEIGHTS = (5, 2, 1)
CAP = 3.0
#: Documents in a range bucket, about; sources that are broadcast at most; the least quality weight.
BUCKET_ROWS, FEW_SOURCES, LEAST = 2000, 10_000, 1e-6
_WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    """Number of words; null: 0.  A word starts where a separator or nothing stands before it."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def allot(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (source, size, ...) with target: the total of all sizes shared by weight, a target stopping at cap times its size.

    Weights repeat over the sources in code point order, null last.  What a stopped source leaves is
    shared again by weight, so all others get the same amount for each unit of weight: the largest
    that any order of stopping gives.  The sources of a table are few enough to sort in one task.
    """
    place = F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    some = F.col("size") > 0
    full, w = F.when(some, cap * F.col("size")).otherwise(0.0), F.when(some, F.col("w")).otherwise(0.0)
    before = W.partitionBy().orderBy(F.when(some, cap * F.col("size") / F.col("w")).otherwise(0.0), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumns({"_left": F.sum("size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0)), "_open": F.sum(w).over(everything) - F.coalesce(F.sum(w).over(before), F.lit(0.0))})
    unit = F.max(F.when(some, F.col("_left") / F.col("_open"))).over(everything)
    return s.withColumn("target", F.when(some, F.least(full, unit * F.col("w"))).otherwise(0.0)).drop("w", "_left", "_open")


def variate(key: Column, seed: int) -> Column:
    """A number between 0 and 1 from the first 52 bits of the MD5 of the key and the seed."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, size: Column, weight: Column | None = None, source: str = "source", key: str = "doc_id", weights=WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted) beside its own columns.

    Targets: see allot.  Reruns agree: variates are hashes of the key, ties order by key and size.
    Documents of equal key draw equal variates; a null key draws by the row's other values.  A null,
    NaN or non-positive quality weight counts as LEAST.  A document of size 0 or null size is never
    taken.  What a source's documents give sums to its target, rounded down.  Empty table: empty table.
    Columns of docs named as the four results are replaced, all others stay, whatever their names.
    """
    names = [c for c in docs.columns if c.lower() not in RESULT]
    plain = [c for c, t in docs.select(*kern.cols(names)).dtypes if "map<" not in t and "variant" not in t]
    own = F.concat(F.lit("null "), F.hex(F.xxhash64(*kern.cols(plain)))) if plain else F.lit("null")
    w = F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0)).cast("double")
    d = docs.select(
        F.struct(*kern.cols(names)).alias("row"), kern.cols([source])[0].alias("source"), kern.cols([key])[0].alias("id"), F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0)).alias("size"),
        F.when((w > LEAST) & ~F.isnan(w), w).otherwise(LEAST).alias("w"), variate(F.coalesce(kern.cols([key])[0].cast("string"), own), seed).alias("u"),
    )
    d = d.withColumns({"key": -F.log("u") / F.col("w"), "scale": F.floor(F.log2("w"))})
    scales = d.groupBy("source", "scale").agg(F.sum("size").alias("z"), F.count(F.lit(1)).alias("n"))
    sources = scales.groupBy("source").agg(F.sum("z").alias("size"), F.sum("n").alias("n"), F.collect_list(F.struct("scale", "n")).alias("scales"))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    info = allot(sources, weights, cap).withColumn("epochs", rate.cast("long"))
    info = info.select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "epochs", F.floor(F.col("target") - F.col("epochs") * F.col("size") + 1e-6).cast("long").alias("rest"),
        F.greatest(F.lit(1), F.floor(F.col("n") / BUCKET_ROWS)).alias("parts"), F.transform("scales", lambda x: F.struct((x["n"] / F.col("n")).alias("share"), (1.4 * F.pow(F.lit(2.0), x["scale"])).alias("w"))).alias("scales"),
    )
    info = scratch.stored(info, "sources")
    few = info.count() <= FEW_SOURCES
    d = d.join(F.broadcast(info) if few else info, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    under = F.aggregate("scales", F.lit(0.0), lambda a, x: a + x["share"] * (1.0 - F.exp(-x["w"] * F.col("key"))))
    d = d.withColumn("part", F.floor(under * F.col("parts")).cast("long")).drop("scales", "u", "w", "scale", "parts")
    part = d.groupBy(F.col("source").alias("s"), F.col("part").alias("p")).agg(F.sum("size").alias("z"))
    before = part.withColumn("before", F.coalesce(F.sum("z").over(W.partitionBy("s").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("z")
    d = d.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    inside = W.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("upto", F.col("before") + F.sum("size").over(inside))
    # what the budget leaves after the documents before; size at most, so taken stays within cap times it
    rest = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - (F.col("upto") - F.col("size"))))
    over = (F.floor(F.lit(cap) * F.col("size")) - F.col("epochs") * F.col("size")).cast("long")
    return d.select(*[F.col("row").getField(c).alias(c) for c in names], "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.least(rest, over)).alias("taken"))
