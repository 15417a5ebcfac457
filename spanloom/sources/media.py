"""Media probe output, cache listings and fingerprints as tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import ranged

PROBE = (
    "format struct<filename:string,duration:string,size:string>, "
    "streams array<struct<codec_type:string,codec_name:string,duration:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,disposition:struct<attached_pic:int>>>"
)
#: Accepted media extensions (fixed values).
MEDIA = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "flv", "wmv", "mpg", "mpeg", "ts", "mp3", "wav", "m4a", "aac", "flac", "ogg", "opus")


def _rate(raw):
    num, den = F.split(F.coalesce(raw, F.lit("0/0")), "/")[0].try_cast("double"), F.get(F.split(F.coalesce(raw, F.lit("0/0")), "/"), 1).try_cast("double")
    return F.when(den > 0, num / den)


def parse_probe(raw: DataFrame, col: str = "probe") -> DataFrame:
    """A row of media columns for each probe document (JSON text): the longest of the durations, the first real video stream, the first audio stream."""
    d = raw.withColumn("_p", F.from_json(col, PROBE))
    video = F.get(F.filter("_p.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), 0)
    audio = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "audio"), 0)
    d = d.withColumns({"_v": video, "_a": audio})
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    out = {
        "duration": F.greatest(F.lit(0.0), num("_p.format.duration"), num("_v.duration"), num("_a.duration")),
        "width": F.coalesce("_v.width", F.lit(0)),
        "height": F.coalesce("_v.height", F.lit(0)),
        "fps": F.coalesce(_rate(F.col("_v.avg_frame_rate")), _rate(F.col("_v.r_frame_rate")), F.lit(0.0)),
        "size_bytes": F.col("_p.format.size").try_cast("long"),
        "vcodec": F.coalesce("_v.codec_name", F.lit("")),
        "acodec": F.coalesce("_a.codec_name", F.lit("")),
        "has_audio": F.col("_a").isNotNull(),
        "filename": F.regexp_extract("_p.format.filename", r"([^/\\]*)$", 1),
    }
    return d.withColumns(out).drop("_p", "_v", "_a")


def is_media(path):
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(list(MEDIA))


def cache_entries(spark: SparkSession, root: str, reserved=("models", "thumbs")) -> DataFrame:
    """Folders under a cache root with their size in MB, by name; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rest = F.substring_index("path", root.rstrip("/").split(":")[-1].rstrip("/") + "/", -1)
    return f.select(F.substring_index(rest, "/", 1).alias("name"), "length").where(~F.col("name").isin(list(reserved))).groupBy("name").agg((F.sum("length") / 1048576).alias("size_mb")).orderBy("name")


def fingerprints(spark: SparkSession, path: str, sample: int = 4 << 20) -> DataFrame:
    """Content fingerprint of each file: SHA-256 over size, whole-second time, name, first and (over twice the sample) last bytes; 20 hex digits.

    Spark lists the files; tasks seek to the two ends and read those alone, so a file may have any size.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.select("path", "length", F.unix_timestamp("modificationTime").alias("time")).repartition(4 * spark.sparkContext.defaultParallelism)

    def run(frames):
        for g in frames:
            out = []
            for at, length, time in g.itertuples(index=False):
                h = hashlib.sha256(f"{length}|{time}|{at.rsplit('/', 1)[-1]}".encode())
                with ranged.opened(at) as source:
                    h.update(source.read_at(min(sample, length), 0))
                    if length > 2 * sample:
                        h.update(source.read_at(sample, length - sample))
                out.append(h.hexdigest()[:20])
            yield g.assign(fingerprint=out)[["path", "fingerprint"]]

    return f.mapInPandas(run, "path string, fingerprint string")
