"""Sentences, pauses, topic shifts and blocks of a transcript.

The folds work on one transcript's arrays; DataFrame wrappers run them in
mapInPandas over rows that each hold a whole transcript, so no shuffle is needed
and transcripts are the unit of parallelism.
"""

from __future__ import annotations

import decimal
import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import text as T

# Fixed values.
SENTENCE_END = re.compile(r'[.!?…。！？؟]+["\'»”\)\]]*$')
#: What a token that SENTENCE_END finds can end with.
_CLOSERS = frozenset('.!?…。！？؟"\'»”)]\n')
CLAUSE_END = re.compile(r"[,;:—–-]$")
ABBREVIATIONS = set("mr. mrs. ms. dr. prof. sr. jr. st. vs. etc. e.g. i.e. inc. ltd. co. no. fig. approx. m. mme. mlle. pr. cf. ex. env. art.".split())


@dataclass(frozen=True)
class Options:
    """Pauses in seconds, sizes in words; what parts the words of a text."""

    pause_break: float = 0.65
    hard_pause: float = 1.10
    min_words: int = 4
    max_words: int = 48
    min_duration: float = 0.8
    white: T.White = T.UNICODE


def split(text: str, white: T.White = T.UNICODE) -> list[str]:
    """Words, as `T.words` splits them."""
    return re.findall(f"[^{white.parts}]+", text)


def ends_sentence(token: str, white: T.White = T.UNICODE) -> bool:
    return token[-1:] in _CLOSERS and bool(SENTENCE_END.search(token)) and white.lower(token) not in ABBREVIATIONS


def closings(start, end, words: list[str], o: Options = Options(), begin: int = 0, scan: int = 0):
    """(first word, last word, where the scan stood) of each sentence that closes before the last word, for a sentence open from `begin` on and words before `scan` seen."""
    for i in range(scan, len(words) - 1):
        size = i - begin + 1
        gap = start[i + 1] - end[i]
        mark = i
        if size >= 2 and gap >= o.hard_pause:
            pass
        elif size >= o.min_words and (gap >= o.pause_break or (end[i] - start[begin] >= o.min_duration and ends_sentence(words[i], o.white))):
            pass
        elif size >= o.max_words:
            reach = min(9, max(2, size - 3))
            mark = next((i - b for b in range(reach - 1) if CLAUSE_END.search(words[i - b])), i)
        else:
            continue
        yield begin, mark, i
        begin = mark + 1


def sentence_ranges(start, end, words: list[str], o: Options = Options()) -> list[tuple[int, int]]:
    """First and last word of each sentence.

    A word closes a sentence at a hard pause (two words or more), at a sentence mark
    (min_words and min_duration) or at a pause (min_words); at max_words the sentence is
    cut after the nearest clause mark among its last words, if there is one.
    """
    out = [(a, m) for a, m, _ in closings(start, end, words, o)]
    begin = out[-1][1] + 1 if out else 0
    return out + [(begin, len(words) - 1)] if len(words) > begin else out


def sentence_text(words: list[str], white: T.White = T.UNICODE) -> str:
    return re.sub(f"[{white.parts}]+([,.!?;:…])", r"\1", " ".join(words).strip(white.parts))


def sentences(start: np.ndarray, end: np.ndarray, words: list[str], o: Options = Options()) -> dict:
    """Arrays of a transcript's sentences, with the pauses beside them (first: its own start; last: 2 s)."""
    r = sentence_ranges(start.tolist(), end.tolist(), words, o)
    a, b = np.array([x for x, _ in r], int), np.array([y for _, y in r], int)
    s, e = (start[a], end[b]) if len(r) else (np.zeros(0), np.zeros(0))
    texts = [sentence_text(words[x : y + 1], o.white) for x, y in r]
    gap = np.round(s[1:] - e[:-1], 3) if len(r) else np.zeros(0)
    before = np.maximum(0.0, np.concatenate([s[:1], gap]))
    after = np.maximum(0.0, np.concatenate([gap, [2.0]])) if len(r) else np.zeros(0)
    return {"start": s, "end": e, "text": texts, "pause_before": before, "pause_after": after, "n_words": np.array([len(split(t, o.white)) for t in texts], int), "first": a, "last": b}


def build(transcripts: DataFrame, o: Options = Options()) -> DataFrame:
    """transcript_id, language, duration, sentences (array, in order) of rows with words; a transcript without words has none."""

    def run(batches):
        for batch in batches:
            for lo, some in transcripts_of(batch, 3):
                part = batch.slice(lo, some)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], listed(*sentence_arrays(part, 3, o))], names=["transcript_id", "language", "duration", "sentences"])

    return timed(transcripts).mapInArrow(run, f"transcript_id string, language string, duration double, sentences array<{schemas.SENTENCE}>")


def timed(transcripts: DataFrame) -> DataFrame:
    """transcript_id, language, duration and the words' start, end and text: arrays by field, where structs would be an object a word."""
    return transcripts.select("transcript_id", "language", "duration", *[F.col(f"words.{c}").alias(f"_{c}") for c in ("start", "end", "text")])


def transcripts_of(batch: pa.RecordBatch, at: int, limit: int = 1 << 17):
    """Runs (first row, rows) of an Arrow batch whose lists in column `at` have about `limit` items; a longer one is a run alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi - lo
        lo = hi


def bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each row of lists begins among `lists.flatten()`, and the end of the last; null is empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def sentence_arrays(batch: pa.RecordBatch, at: int, o: Options) -> tuple[np.ndarray, dict]:
    """(bounds, fields) of the sentences of all transcripts of a batch, whose words' start, end and text begin at column `at`."""
    cut = bounds(batch.column(at))
    start, end = (batch.column(at + k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
    words = batch.column(at + 2).flatten().to_numpy(zero_copy_only=False).tolist()
    got = [sentences(start[a:z], end[a:z], words[a:z], o) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
    out = {c: np.concatenate([g[c] for g in got]) if got else np.zeros(0) for c in ("start", "end", "pause_before", "pause_after", "n_words")}
    n = [len(g["text"]) for g in got]
    out["idx"] = np.concatenate([np.arange(k) for k in n]) if got else np.zeros(0)
    out["text"] = [t for g in got for t in g["text"]]
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), out


def listed(cut: np.ndarray, fields: dict) -> pa.ListArray:
    """Sentences as an Arrow column."""
    kinds = {"idx": pa.int32(), "start": pa.float64(), "end": pa.float64(), "text": pa.string(), "pause_before": pa.float64(), "pause_after": pa.float64(), "n_words": pa.int32()}
    each = pa.StructArray.from_arrays([pa.array(fields[c] if c == "text" else np.asarray(fields[c]).astype(kind.to_pandas_dtype()), kind) for c, kind in kinds.items()], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), each)


def explode(built: DataFrame) -> DataFrame:
    return built.select("transcript_id", "language", F.explode("sentences").alias("s")).select("transcript_id", "language", "s.*")


def topic_shift(rows: DataFrame, key: str, order: str, text: str = "text", window: int = 6, normalise: bool = True) -> DataFrame:
    """1 - overlap coefficient of the topic tokens of `window` rows before and from each row, over the group's maximum.

    Zero within `window` rows of either edge, and where a side is empty.
    """
    base = rows.withColumn("_tok", T.topic_tokens(F.coalesce(F.col(text), F.lit(""))))
    w = W.partitionBy(key).orderBy(order)
    left = F.array_distinct(F.flatten(F.collect_list("_tok").over(w.rowsBetween(-window, -1))))
    right = F.array_distinct(F.flatten(F.collect_list("_tok").over(w.rowsBetween(0, window - 1))))
    d = base.withColumns({"_l": left, "_r": right, "_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(key))})
    least = F.least(F.size("_l"), F.size("_r"))
    raw = F.when((F.col("_i") >= window) & (F.col("_i") < F.col("_n") - window) & (least > 0), 1.0 - F.size(F.array_intersect("_l", "_r")) / least).otherwise(0.0)
    d = d.withColumn("shift", raw)
    if normalise:
        top = F.max("shift").over(W.partitionBy(key))
        d = d.withColumn("shift", F.round(F.col("shift") / F.when(top > 0, top).otherwise(1.0), 3))
    return d.drop("_tok", "_l", "_r", "_i", "_n")


def topic_array(built: DataFrame, window: int = 6, white: T.White = T.UNICODE) -> DataFrame:
    """built with `topic`, the normalised shift of each sentence, worked out on the transcript's own array: no shuffle."""

    def shifts(tok):
        def one(x, i):
            ready = (i >= window) & (i < F.size(tok) - window)
            sides = F.struct(F.array_distinct(F.flatten(F.slice(tok, i - window + 1, F.lit(window)))).alias("l"), F.array_distinct(F.flatten(F.slice(tok, i + 1, F.lit(window)))).alias("r"))
            return F.when(ready, T.let(sides, lambda p: F.coalesce(F.try_divide(F.size(F.array_intersect(p["l"], p["r"])), F.least(F.size(p["l"]), F.size(p["r"]))), F.lit(1.0)))).otherwise(1.0)

        return F.transform(tok, one)

    def scaled(raw):
        top = F.coalesce(F.nullif(1.0 - F.array_min(raw), F.lit(0.0)), F.lit(1.0))
        return T.let(top, lambda t: F.transform(raw, lambda v: F.round((1.0 - v) / t, 3)))

    tokens = F.transform("sentences", lambda s: T.topic_tokens(s["text"], white))
    return built.withColumn("topic", T.let(T.let(tokens, shifts), scaled))


@functools.lru_cache(1 << 16)
def _thousandths(x: float) -> float:
    """Rounded half up as it prints, to three digits."""
    return float(decimal.Decimal(repr(x)).quantize(decimal.Decimal("0.001"), decimal.ROUND_HALF_UP))


class _Letters(dict):
    """Translates what is no letter to a space."""

    def __missing__(self, k: int) -> int:
        self[k] = k if unicodedata.category(chr(k))[0] == "L" else 32
        return self[k]


_LETTERS, _STOP = _Letters(), frozenset(T.STOPWORDS)


def topic_set(text: str, white: T.White = T.UNICODE) -> set[str]:
    """The tokens of `T.topic_tokens`."""
    if not text.isascii():
        text = (text.replace("İ", "i").replace("Σ", "σ") if white == T.SQL else text).lower().translate(_LETTERS)
        return {w for w in text.split(" ") if len(w) >= 3} - _STOP
    return set(_ASCII_TOKENS.findall(text.lower())) - _STOP


_ASCII_TOKENS = re.compile("[a-z]{3,}")


def topic_shifts(texts: list[str], window: int = 6, white: T.White = T.UNICODE) -> list[float]:
    """The column that `topic_array` gives, for one transcript."""
    n = len(texts)
    raw = [1.0] * n
    if n > 2 * window:
        sets = [topic_set(t, white) for t in texts]
        for i in range(window, n - window):
            left, right = set().union(*sets[i - window : i]), set().union(*sets[i : i + window])
            least = min(len(left), len(right))
            raw[i] = len(left & right) / least if least else 1.0
    top = (1.0 - min(raw)) if n else 0.0
    return [_thousandths((1.0 - v) / (top or 1.0)) for v in raw]


def blocks(start: np.ndarray, end: np.ndarray, seconds: float = 420.0, overlap: float = 45.0) -> list[tuple[int, int]]:
    """Overlapping sentence ranges under `seconds` long; each begins `overlap` before the end of the last, at least one sentence on."""
    out, i, n = [], 0, len(start)
    while i < n:
        far = np.flatnonzero(end[i + 1 :] - start[i] >= seconds)
        j = i + int(far[0]) if len(far) else n - 1
        out.append((i, j))
        if j >= n - 1:
            return out
        early = np.flatnonzero(start[i : j + 1] <= end[j] - overlap)
        i = max(i + 1, i + int(early[-1]) if len(early) else i)
    return out


def block_rows(built: DataFrame, seconds: float = 420.0, overlap: float = 45.0) -> DataFrame:
    def run(frames):
        for f in frames:
            out = {"transcript_id": [], "block": [], "start_idx": [], "end_idx": []}
            for tid, s in zip(f["transcript_id"], f["sentences"]):
                for k, (a, b) in enumerate(blocks(np.array([x["start"] for x in s], float), np.array([x["end"] for x in s], float), seconds, overlap)):
                    for c, v in zip(out, (tid, k, a, b)):
                        out[c].append(v)
            yield pd.DataFrame(out)

    return built.select("transcript_id", "sentences").mapInPandas(run, "transcript_id string, block int, start_idx int, end_idx int")


def pauses(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows (start, end) with the pause before and after each in order, none below zero: the first has its own start, the last 2 s."""
    w = W.partitionBy(key).orderBy(order)
    before = F.greatest(F.lit(0.0), F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0.0)))
    after = F.greatest(F.lit(0.0), F.coalesce(F.lead("start").over(w) - F.col("end"), F.lit(2.0)))
    return rows.withColumns({"pause_before": before, "pause_after": after})


def sentence_at(sents: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (transcript_id, t): the first sentence that ends at or after t, else the last.

    Points and sentence ends are one sequence; a point takes the next end after it.
    """
    s = sents.select("transcript_id", F.col("end").alias("t"), F.col("idx").alias("_idx"))
    p = points.select("transcript_id", "t").distinct().withColumn("_idx", F.lit(None).cast(dict(sents.dtypes)["idx"]))
    # backwards, so that the frame only grows: one step a row
    w = W.partitionBy("transcript_id").orderBy(F.desc("t"), F.col("_idx").desc_nulls_last())
    after = F.last("_idx", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    last = F.max("_idx").over(W.partitionBy("transcript_id"))
    at = s.unionByName(p).withColumns({"idx": F.coalesce(after, last), "_known": F.col("_idx").isNotNull()}).where("not _known and idx is not null").select("transcript_id", "t", "idx")
    return points.join(at, ["transcript_id", "t"])


def snap_range(sents: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (transcript_id, start, end) with start_idx and end_idx, the sentences at either end, in order."""
    points = ranges.select("transcript_id", F.col("start").alias("t")).union(ranges.select("transcript_id", F.col("end").alias("t"))).distinct()
    at = sentence_at(sents, points)
    first, last = at.select("transcript_id", F.col("t").alias("start"), F.col("idx").alias("_a")), at.select("transcript_id", F.col("t").alias("end"), F.col("idx").alias("_b"))
    d = ranges.join(first, ["transcript_id", "start"]).join(last, ["transcript_id", "end"])
    return d.withColumns({"start_idx": F.least("_a", "_b"), "end_idx": F.greatest("_a", "_b")}).drop("_a", "_b")


def require_speech(sents: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Per transcript: sentences, words, speech seconds, and whether there is enough speech (4 sentences, 25 words); with media (transcript_id, duration) also the share of speech."""
    g = sents.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n_words").alias("n_words"), F.sum(F.col("end") - F.col("start")).alias("speech_seconds"))
    g = g.withColumn("enough", (F.col("n_sentences") >= 4) & (F.col("n_words") >= 25))
    if media is None:
        return g
    m = media.select("transcript_id", F.col("duration").alias("_d")).join(g, "transcript_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(dict(g.dtypes)[c])) for c in ("n_sentences", "n_words", "speech_seconds")}
    m = m.withColumns(zero | {"enough": F.coalesce("enough", F.lit(False))})
    return m.withColumn("speech_ratio", F.when(F.col("_d") > 0, F.least(F.lit(1.0), F.col("speech_seconds") / F.col("_d"))).otherwise(0.0)).drop("_d")


def duration_guard(media: DataFrame, low: float = 20.0, duration: str = "duration") -> DataFrame:
    """media with `verdict`: too_short under `low` seconds (or unknown), few_clips under three times that, else ok."""
    d = F.coalesce(F.col(duration), F.lit(0.0))
    return media.withColumn("verdict", F.when(d < low, F.lit("too_short")).when(d < 3 * low, F.lit("few_clips")).otherwise(F.lit("ok")))
