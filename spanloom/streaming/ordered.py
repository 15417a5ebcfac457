"""Order-dependent operators on streams: keyed state and event-time timers put late rows back in order before a fold sees them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from spanloom.operators import camera

#: The state store that list state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

Fold = Callable[[tuple | None, list[tuple]], tuple[tuple | None, Iterable[tuple]]]


class _InOrder(StatefulProcessor):
    """Rows wait in list state until the watermark has passed their time; then a fold takes them in order of all their fields."""

    def __init__(self, row: dict[str, str], carry: str, out: list[str], fold: Fold):
        self.row, self.carry, self.out, self.fold = row, carry, out, fold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.row.items()))
        self.carried = handle.getValueState("carried", self.carry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # by position: the frames rename columns that begin with a line
        fresh = [tuple(None if pd.isna(x) else x for x in r) for f in rows for r in f.iloc[:, 1 : 1 + len(self.row)].astype(object).itertuples(index=False)]
        self.waiting.appendList(fresh)
        due = -(-min(int(r[0]) for r in fresh) // 1000)
        if not any(t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] <= passed), key=lambda r: tuple((x is None, x) for x in r))
        rest = [r for r in rows if r[0] > passed]
        if rest:
            self.waiting.put(rest)
            due = -(-min(int(r[0]) for r in rest) // 1000)
            if not any(t <= due for t in self.handle.listTimers() if t != expiredTimerInfo.getExpiryTimeInMs()):
                self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        found: list[tuple] = []
        if ready:
            carry, out = self.fold(tuple(self.carried.get()) if self.carried.exists() else None, [r[1:] for r in ready])
            found = list(out)
            if carry is not None:
                self.carried.update(carry)
        yield pd.DataFrame([(key[0], *r) for r in found], columns=self.out)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, ts: str, fields: dict[str, str], carry: str, out: str, fold: Fold, late: str) -> DataFrame:
    """`fold(carry, rows)` over each key's rows in order of ts and then `fields` (name: type), nulls last; it returns the next carry and the rows to send.

    A row is folded when the watermark, `late` behind the newest ts of the stream, has passed its ts, so a row that
    comes later than that is dropped by Spark and one that comes earlier is never out of order.  State is the rows of a
    key that wait, at most those of `late`, and one carry (`carry` is its schema).  Rows without ts are dropped.
    `out` is the schema of what comes out; its first field is the key.
    """
    d = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    # the time as microseconds: rows in state keep it exactly
    d = d.select(key, F.unix_micros(ts).alias("_us"), *fields, ts)
    names = [x.strip().split(" ")[0] for x in out.split(",")]
    return d.groupBy(key).transformWithStateInPandas(_InOrder({"_us": "long"} | fields, carry, names, fold), out, "Append", "EventTime")


def gaps(stream: DataFrame, key: str = "transcript_id", ts: str = "ts", start: str = "start", end: str = "end", least: float = 2.5, late: str = "1 hour") -> DataFrame:
    """(key, gap_start, gap_end) of at least `least` that no interval before covers, sent once the watermark has passed the interval that ends the gap.

    Equal to the batch `intervals.gaps` without a total, where no row is later than `late`; ts is the time of `start`.
    """

    def fold(carry, rows):
        reach, found = (carry or (0.0,))[0], []
        for a, b in rows:
            if a is None or b is None:
                continue
            if a - reach >= least:
                found.append((reach, a))
            reach = max(reach, b)
        return (reach,), found

    return in_order(stream, key, ts, {start: "double", end: "double"}, "reach double", f"{key} {dict(stream.dtypes)[key]}, gap_start double, gap_end double", fold, late)


def smoothed(stream: DataFrame, key: str = "transcript_id", ts: str = "ts", alpha: float = camera.ALPHA, late: str = "1 hour") -> DataFrame:
    """(key, t, x): samples (key, ts, t, cx, cut) smoothed as `camera.smooth` does, each sent once the watermark has passed it.

    Samples before the first that sees something take its value, so they are carried until it comes: with the first
    seen one they are sent, and a key that never sees anything sends nothing.
    """

    def fold(carry, rows):
        cur, early = carry or (None, [])
        early, found = list(early), []
        for t, cx, cut in rows:
            if cx is None and cur is None:
                early.append(t)
                continue
            if cx is not None:
                first = cur is None
                if first:
                    found += [(e, cx) for e in early]
                    cur, early = cx, []
                cur = cx if cut else cur + alpha * (cx - cur)
            found.append((t, cur))
        return (cur, early), found

    return in_order(stream, key, ts, {"t": "double", "cx": "double", "cut": "boolean"}, "cur double, early array<double>", f"{key} {dict(stream.dtypes)[key]}, t double, x double", fold, late)


def clip_to(words: DataFrame, ranges: DataFrame, group: str, longest_word: str, longest_range: str, late: str = "1 hour") -> DataFrame:
    """Words (group, ts, start, end, ...) that overlap ranges (group, r_ts, r_start, r_end, ...), cut to them: an inner join of two streams.

    ts and r_ts are the times of start and r_start.  The bounds on lengths let Spark forget a word or range when the
    watermark shows that no partner can come; a longer one stops the query, as its partners could be missed.
    """
    def bounded(d, t, a, b, most):
        whole = F.expr(f"cast(INTERVAL {most} as interval day to second)")
        fits = F.timestamp_seconds(F.lit(0)) + F.make_dt_interval(secs=F.col(b) - F.col(a)) <= F.timestamp_seconds(F.lit(0)) + whole
        return d.where(F.coalesce(fits, F.lit(True)) | F.raise_error(F.lit(f"an interval is longer than {most}")).cast("boolean")).withWatermark(t, late)

    w = bounded(words, "ts", "start", "end", longest_word)
    r = bounded(ranges.withColumnRenamed(group, "_g"), "r_ts", "r_start", "r_end", longest_range)
    near = F.expr(f"ts >= r_ts - INTERVAL {longest_word} AND ts <= r_ts + INTERVAL {longest_range}")
    j = w.join(r, (F.col(group) == F.col("_g")) & near & (F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end")))
    return j.withColumns({"start": F.greatest("start", "r_start"), "end": F.least("end", "r_end")}).drop("_g", "r_start", "r_end", "r_ts")
