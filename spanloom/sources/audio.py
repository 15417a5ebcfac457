"""PCM audio by byte ranges: a data source that walks RIFF chunks, spans of samples as rows, levels and slices natively."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.sources import ranged

#: Frames of a span, spans of a partition; levels of silence and of what is too short to judge (fixed values).
SPAN, SPANS = 16_000, 256
SILENT, SHORT = -180.0, -120.0


@dataclass
class Pcm:
    """Where a file's frames lie: the first byte of the data chunk, its bytes, and the format."""

    at: int
    size: int
    rate: int
    channels: int
    bits: int


def walk(source, length: int) -> Pcm | None:
    """The format and data chunks of a RIFF/WAVE file, by ranged reads of chunk headers; None if it is none or not plain PCM.

    A data chunk that claims more than the file holds ends with the file; odd chunks are padded; unknown chunks are skipped.
    """
    head = source.read_at(min(12, length), 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", source.read_at(8, at))
        if name == b"fmt " and size >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", source.read_at(16, at + 8))
            if kind not in (1, 0xFFFE) or not channels or not rate or bits not in (8, 16, 32):
                return None
            form = rate, channels, bits
        elif name == b"data":
            return Pcm(at + 8, min(size, length - at - 8), *form) if form else None
        at += 8 + size + size % 2
    return None


class Ranges(InputPartition):
    """Runs of spans: (path, length, first frame) each."""

    def __init__(self, runs: list[tuple[str, int, int]]):
        self.runs = runs


#: Small files make about so many partitions together, twice as many at most, if those would not hold more bytes than a run of spans; frames of a batch.
BUNDLES, GATHER = 256, 1 << 16


class PcmReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.frames, self.spans = options["path"], int(options.get("span", SPAN)), int(options.get("spans", SPANS))

    def partitions(self):
        """Runs of spans that the files' sizes allow (two bytes a frame is the least a plan must allow for); short ones share a partition."""
        files = ranged.listed(self.path)
        step = self.frames * self.spans
        most = min(2 * step, max(1, sum(length for _, length in files) // BUNDLES))
        out, held = [], 0
        for path, length in files:
            for first in range(0, max(1, length // 2), step):
                size = min(2 * step, length - 2 * first)
                if not out or held + size > most:
                    out.append([])
                    held = 0
                out[-1].append((path, length, first))
                held += size
        return [Ranges(runs) for runs in out]

    def read(self, part):
        rows, samples, held = [], [], 0
        for path, length, begin in part.runs:
            with ranged.opened(path) as source:
                pcm = walk(source, length)
                if pcm is None or pcm.bits != 16 or pcm.channels != 1:  # as the speech recogniser's input must be
                    continue
                total = pcm.size // 2
                for first in range(begin, min(total, begin + self.frames * self.spans), self.frames):
                    n = min(self.frames, total - first)
                    raw = source.read_at(2 * n, pcm.at + 2 * first)
                    rows.append((path, first // self.frames, first, total, pcm.rate))
                    samples.append(pa.Array.from_buffers(pa.int16(), len(raw) // 2, [None, pa.py_buffer(raw)]))
                    held += n
                    if held >= GATHER:
                        yield self.packed(rows, samples)
                        rows, samples, held = [], [], 0
        if rows:
            yield self.packed(rows, samples)

    def packed(self, rows, samples) -> pa.RecordBatch:
        ends = [0]
        for x in samples:
            ends.append(ends[-1] + len(x))
        kinds = {"path": pa.string(), "span": pa.int64(), "first": pa.int64(), "total": pa.int64(), "rate": pa.int32()}
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(samples))], names=[*kinds, "samples"])


class PcmSource(DataSource):
    """Mono 16-bit WAV files under `path` as rows (path, span, first frame, frames in all, rate, samples); no task holds more than GATHER frames and a span."""

    @classmethod
    def name(cls):
        return "pcm"

    def schema(self):
        return "path string, span long, first long, total long, rate int, samples array<short>"

    def reader(self, schema):
        return PcmReader(self.options)


def read(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """Spans of all WAV files under a path, in partitions of byte ranges: a file of any size is many tasks."""
    spark.dataSource.register(PcmSource)
    return spark.read.format("pcm").option("span", span).load(path)


def _met(spans: DataFrame, cuts: DataFrame, span: int) -> DataFrame:
    """Each cut (path, start, end in seconds, any other columns) with the part of every span it covers: _a, _b (its frames) and _part."""
    form = spans.groupBy("path").agg(F.first("rate").alias("_rate"), F.first("total").alias("_total"))
    c = cuts.join(form, "path")
    a = F.greatest(F.lit(0), F.floor(F.col("start") * F.col("_rate")))
    b = F.least(F.col("_total"), F.floor(F.col("end") * F.col("_rate")))
    c = c.withColumns({"_a": a.cast("long"), "_b": b.cast("long")}).withColumn("_span", F.explode_outer(F.when(F.col("_b") > F.col("_a"), F.sequence(F.floor(F.col("_a") / span), F.floor((F.col("_b") - 1) / span)))))
    s = spans.select(F.col("path").alias("_path"), F.col("span").alias("_of"), "first", "samples")
    j = c.join(s, (F.col("path") == F.col("_path")) & (F.col("_span") == F.col("_of")), "left")
    lo = F.greatest(F.col("_a"), F.col("first")) - F.col("first")
    hi = F.least(F.col("_b"), F.col("first") + F.size("samples")) - F.col("first")
    return j.withColumn("_part", F.slice("samples", (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int"))).drop("samples", "_path", "_of")


def levels(spans: DataFrame, cuts: DataFrame, span: int = SPAN) -> DataFrame:
    """cuts (path, start, end) with `db`, the root mean square in dBFS: SHORT under a tenth of a second, SILENT without a sound."""

    @F.pandas_udf("long")
    def energy(parts: pd.Series) -> pd.Series:
        return pd.Series([0 if p is None else int(np.square(p, dtype=np.int64).sum()) for p in parts], dtype="int64")

    m = _met(spans, cuts, span).withColumn("_e", energy("_part"))
    g = m.groupBy(*cuts.columns).agg(F.sum("_e").alias("_e"), F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.first("_rate").alias("_rate"))
    n = F.col("_b") - F.col("_a")
    db = F.when(n < F.floor(F.col("_rate") / 10), SHORT).when(F.col("_e") == 0, SILENT).otherwise(20 * F.log10(F.sqrt(F.col("_e") / n) / 32768.0))
    return g.withColumn("db", db).drop("_e", "_a", "_b", "_rate")


def slices(spans: DataFrame, cuts: DataFrame, span: int = SPAN) -> DataFrame:
    """cuts (path, start, end) with `wav`, a WAV file of just those frames (null: none); a cut is a task's unit."""
    m = _met(spans, cuts, span)
    g = m.groupBy(*cuts.columns, "_rate").agg(F.array_sort(F.collect_list(F.when(F.size("_part") > 0, F.struct("first", "_part")))).alias("_l"))
    g = g.withColumn("_s", F.flatten(F.transform("_l", lambda x: x["_part"]))).drop("_l")

    @F.pandas_udf("binary")
    def packed(samples: pd.Series, rate: pd.Series) -> pd.Series:
        def one(s, r):
            data = pa.array(s, pa.int16()).buffers()[1].to_pybytes()[: 2 * len(s)] if s is not None and len(s) else b""
            return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, r, 2 * r, 2, 16) + b"data" + struct.pack("<I", len(data)) + data if data else None

        return pd.Series([one(s, int(r)) for s, r in zip(samples, rate)])

    return g.withColumn("wav", packed("_s", "_rate")).drop("_s", "_rate")


def write(rows: DataFrame, folder: str) -> None:
    """A mono 16-bit WAV file `name`.wav under a shared folder for each row (name, rate, samples array<short>)."""

    def put(frames):
        for f in frames:
            for name, rate, samples in zip(f["name"], f["rate"], f["samples"]):
                data = pa.array(samples, pa.int16()).buffers()[1].to_pybytes()[: 2 * len(samples)] if len(samples) else b""
                head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, int(rate), 2 * int(rate), 2, 16) + b"data" + struct.pack("<I", len(data))
                ranged.put(f"{folder}/{name}.wav", head + data)
            yield f[["name"]]

    rows.select(F.col("name").cast("string").alias("name"), F.col("rate").cast("int").alias("rate"), "samples").mapInPandas(put, "name string").count()
