"""Streaming: sessions, running gaps and sentences over unbounded input.  An extension: watermarks and late rows are our own choice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators import segment


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key that a pause of `gap` ends; rows later than `late` are dropped."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sentences(words: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """Sentences of a stream of words (transcript_id, start, end, text), each sent when a later word shows that it is closed, or after `idle_ms` (None: never).

    State is the open words of a transcript: fewer than a sentence's most words.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get[0]) if state.exists else []
        open_ = [tuple(x) for x in zip(*[iter(open_)] * 3)]
        open_ = [(float(a), float(b), t) for a, b, t in open_]
        if state.hasTimedOut:
            state.remove()
            done, rest = [open_] if open_ else [], []
        else:
            for f in frames:
                open_ += list(zip(f["start"], f["end"], f["text"]))
            open_.sort()
            r = segment.sentence_ranges([w[0] for w in open_], [w[1] for w in open_], [w[2] for w in open_])
            done, rest = [open_[a : b + 1] for a, b in r[:-1]], open_[r[-1][0] :] if r else []
            state.update(([str(x) for w in rest for x in w],))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], w[0][0], w[-1][1], segment.sentence_text([x[2] for x in w])) for w in done], columns=["transcript_id", "start", "end", "text"])

    return words.groupBy("transcript_id").applyInPandasWithState(step, "transcript_id string, start double, end double, text string", "open array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
