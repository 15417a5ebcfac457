"""Camera paths from face samples: cuts, smoothing, segments and the crop expression."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import insights

# Fixed values.
FORMATS = {"9:16": (1080, 1920), "4:5": (1080, 1350), "1:1": (1080, 1080), "16:9": (1920, 1080)}
ALPHA, MOVE, PIECE, SAME, DWELL, MOST = 0.35, 0.035, 0.7, 0.006, 0.45, 80


def mark_cuts(samples: DataFrame, group: str, order: str, diff: str) -> DataFrame:
    """samples with `cut`: a difference over 20 and over three times the median positive one; none if over 35 % of a group is flagged."""
    w = W.partitionBy(group)
    d = samples.withColumn("_i", F.row_number().over(w.orderBy(order)))
    m = insights.upper_median(d.where((F.col("_i") > 1) & (F.col(diff) > 0)), group, diff).withColumnRenamed("median", "_m")
    d = d.join(m, group, "left").withColumn("_f", F.coalesce((F.col("_i") > 1) & (F.col(diff) > F.greatest(F.lit(20.0), F.col("_m") * 3.0)), F.lit(False)))
    busy = F.sum(F.col("_f").cast("int")).over(w) / F.count(F.lit(1)).over(w) > 0.35
    return d.withColumn("cut", F.col("_f") & ~busy).drop("_i", "_m", "_f")


def smooth(t: list[float], cx: list[float | None], cut: list[bool], alpha: float = ALPHA) -> list[float]:
    """Exponential smoothing that jumps at cuts and holds where nothing is seen."""
    cur = next((x for x in cx if x is not None), 0.5)
    out = []
    for x, c in zip(cx, cut):
        if x is not None:
            cur = x if c else cur + alpha * (x - cur)
        out.append(cur)
    return out


def _mid(xs: list[float]) -> float:
    return sorted(xs)[len(xs) // 2]


def path(t: list[float], cx: list[float | None], cut: list[bool], duration: float) -> list[tuple[float, float, float, float]]:
    """(t0, t1, x0, x1) pieces: one still frame if the subject is rarely seen, else a still or piecewise linear crop for each shot."""
    seen = [x for x in cx if x is not None]
    if not t:
        return [(0.0, max(0.1, duration), 0.5, 0.5)]
    if len(seen) / len(t) < 0.35:
        x = _mid(seen) if seen else 0.5
        return [(0.0, max(0.1, duration) + 0.5, x, x)]
    pts = list(zip(t, smooth(t, cx, cut)))
    shots: list[list[tuple[float, float]]] = []
    for p, c in zip(pts, cut):
        if c or not shots:
            shots.append([])
        shots[-1].append(p)
    segs = []
    for sh in shots:
        xs, a = [x for _, x in sh], sh[0][0]
        b = sh[-1][0] if sh[-1][0] > a else a + 0.2
        if len(sh) < 3 or max(xs) - min(xs) < MOVE:
            segs.append((a, b, _mid(xs), _mid(xs)))
            continue
        step = max(2, int(round(PIECE * len(sh) / max(0.1, b - a))))
        knots = [*range(0, len(sh) - 1, step), len(sh) - 1]
        segs += [(sh[p][0], sh[q][0], sh[p][1], sh[q][1]) for p, q in zip(knots, knots[1:])]
    segs.sort()
    ends = [max(s[1], n[0]) for s, n in zip(segs, segs[1:])] + [segs[-1][1] if segs[-1][1] >= duration else duration + 0.5]
    closed = [(0.0 if k == 0 and s[0] > 0 else s[0], e, s[2], s[3]) for k, (s, e) in enumerate(zip(segs, ends))]
    return merge(closed)


def merge(segs: list[tuple[float, float, float, float]], most: int = MOST) -> list[tuple[float, float, float, float]]:
    """Join still neighbours of the same framing, absorb still pieces too short to be a move, and drop the least moves beyond `most`."""
    out = segs[:1]
    for a, b, x0, x1 in segs[1:]:
        pa, _, p0, p1 = out[-1]
        still = abs(p1 - p0) < SAME and abs(x1 - x0) < SAME
        if still and abs(x0 - p1) < SAME:
            out[-1] = (pa, b, p0, p0)
        elif still and b - a < DWELL:
            out[-1] = (pa, b, p0, p1)
        else:
            out.append((a, b, x0, x1))
    return fewer(out, most)


def fewer(segs: list[tuple[float, float, float, float]], most: int) -> list[tuple[float, float, float, float]]:
    """Join the piece of the least move (the earliest of equals) to the one before it, until `most` are left.

    A heap holds the moves; a piece that grew gets a new entry and its old ones are skipped.
    """
    out, left = list(segs), len(segs)
    if left <= most:
        return out
    before, version = list(range(-1, left - 1)), [0] * left
    after = [*range(1, left), -1]

    def move(i):
        return abs(out[i][3] - out[i][2]) + abs(out[i][2] - out[before[i]][3])

    heap = [(move(i), i, 0) for i in range(1, left)]
    heapq.heapify(heap)
    while left > max(1, most):
        _, i, v = heapq.heappop(heap)
        if version[i] != v:
            continue
        p, q = before[i], after[i]
        out[p] = (out[p][0], out[i][1], out[p][2], out[i][3])
        after[p], version[i], left = q, -1, left - 1
        if q >= 0:
            before[q] = p  # its own move is from where i ended, which is where p ends now
        if before[p] >= 0:
            version[p] += 1
            heapq.heappush(heap, (move(p), p, version[p]))
    return [x for x, v in zip(out, version) if v >= 0]


def number(v: float) -> str:
    return f"{v:.4f}".rstrip("0").rstrip(".") or "0"


def crop_expression(segs: list[tuple[float, float, float, float]], src_w: int, crop_w: int) -> str:
    """Left edge of the crop at time t as a flat sum of gated terms."""
    span = max(1, src_w - crop_w)
    left = lambda cx: min(float(span), max(0.0, cx * src_w - crop_w / 2.0))
    if not segs:
        return number(span / 2.0)
    segs = merge(segs) if len(segs) > MOST else segs
    terms = []
    for k, (t0, t1, x0, x1) in enumerate(segs):
        a, b = left(x0), left(x1)
        still = abs(a - b) < 0.75 or t1 - t0 < 0.05
        value = number((a + b) / 2.0) if still else f"({number(a)}+({number(b - a)})*(t-{number(t0)})/{number(t1 - t0)})"
        gates = ([f"gte(t,{number(t0)})"] if k > 0 else []) + ([f"lt(t,{number(t1)})"] if k < len(segs) - 1 else [])
        terms.append("*".join([*gates, value]))
    return "+".join(terms)


def paths(samples: DataFrame, durations: DataFrame, group: str = "transcript_id") -> DataFrame:
    """(group, seg, t0, t1, x0, x1) of samples (group, t, cx, cut) and durations (group, duration); samples of one time go by cx, nulls last, then cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "cx", "cut"])
        cx = [None if pd.isna(x) else float(x) for x in pdf["cx"]]
        segs = path(pdf["t"].tolist(), cx, pdf["cut"].tolist(), float(pdf["duration"].iloc[0]))
        return pd.DataFrame([(pdf[group].iloc[0], k, *s) for k, s in enumerate(segs)], columns=[group, "seg", "t0", "t1", "x0", "x1"])

    kind = dict(samples.dtypes)[group]
    return samples.join(durations, group).select(group, "t", "cx", "cut", "duration").groupBy(group).applyInPandas(run, f"{group} {kind}, seg int, t0 double, t1 double, x0 double, x1 double")


def best_frame(samples: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Time of the heaviest face sample of each clip (the earliest of equals), else 18 % into it (0.3 s at least)."""
    m = samples.where(F.col("cx").isNotNull()).groupBy(key).agg(F.max_by("t", F.struct("weight", -F.col("t"))).alias("_t"))
    return clips.join(m, key, "left").withColumn("frame_t", F.coalesce("_t", F.col("start") + F.greatest(F.lit(0.3), (F.col("end") - F.col("start")) * 0.18))).drop("_t")


def needs_crop(src_w: int, src_h: int, fmt: str, layout: str = "crop") -> bool:
    """Whether a subject-tracked crop is planned: not for blurred fits, equal shapes or sources taller than the target."""
    w, h = FORMATS[fmt]
    return layout == "crop" and abs(src_w / src_h - w / h) >= 0.02 and src_w / src_h > w / h
