"""From scored windows to a final, varied set of clips; order-dependent steps work on one transcript's list."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom import schemas
from spanloom.functions import lexicon, scoring
from spanloom.functions import text as T
from spanloom.operators import segment
from spanloom.operators import windows as WN

#: Defaults of a run (fixed values).
CLIPS = {"min_duration": 20.0, "max_duration": 90.0, "target_count": 12, "max_candidates": 60, "iou": 0.4, "merge_ceiling": 0.75, "lambda": 0.7, "min_gap": 5.0, "white": T.UNICODE}


def overlap(a: dict, b: dict) -> float:
    hull = max(a["end"], b["end"]) - min(a["start"], b["start"])
    return max(0.0, min(a["end"], b["end"]) - max(a["start"], b["start"])) / hull if hull > 0 else 0.0


def overall(scores: dict[str, float], weights: dict[str, float]) -> float:
    total = sum(min(cap, max(0.0, scores.get(k, 0.0))) / cap * weights.get(k, cap) for k, cap in scoring.CATEGORY_MAX.items())
    return round(total * 100.0 / (sum(weights.values()) or 100.0), 2)


def virality(scores: dict[str, float], clip_type: str) -> float:
    base = sum(share * scores.get(k, 0.0) / scoring.CATEGORY_MAX[k] * 100 for k, share in scoring.VIRALITY_SHARE.items())
    return round(min(100.0, base + scoring.VIRALITY_BONUS.get(clip_type, 0.0)), 1)


def offline(scorer: WN.Scorer, v: float, i: int, j: int, weights=scoring.CATEGORY_MAX) -> dict:
    """A clip scored by its features alone."""
    return offlines(scorer, [(v, i, j)], weights)[0]


def offlines(scorer: WN.Scorer, found: list[tuple[float, int, int]], weights=scoring.CATEGORY_MAX) -> list[dict]:
    """`offline` of many windows at once."""
    parts = scorer.parts(np.array([i for _, i, _ in found], int), np.array([j for _, _, j in found], int))
    parts = {k: parts[k].tolist() for k in scoring.CATEGORY_MAX}
    out = []
    for n, (v, i, j) in enumerate(found):
        scores = {k: round(parts[k][n] * cap, 1) for k, cap in scoring.CATEGORY_MAX.items()}
        out.append({"start_idx": i, "end_idx": j, "start": float(scorer.s["start"][i]), "end": float(scorer.s["end"][j]), "scores": scores, "overall": overall(scores, weights), "heuristic": round(v, 2), "confidence": 0.35, "clip_type": scorer.dominant(i, j), "source": "heuristic", "merged_from": 1, "reason": "", "title": ""})
    return out


def dedupe(clips: list[dict], start, end, iou: float = 0.4, longest: float = 90.0, ceiling: float = 0.75) -> list[dict]:
    """Visit by overall; a clip joins the kept one it overlaps most (from iou on).  Below the ceiling, and if the union is short enough, the kept one widens to it and takes the better scores."""
    kept: list[dict] = []
    for c in sorted(clips, key=lambda c: (-c["overall"], c["start"])):
        c = {**c, "scores": dict(c["scores"])}
        near = max(kept, key=lambda k: overlap(c, k), default=None)
        share = overlap(c, near) if near else 0.0
        if near is None or share <= 0 or share < iou:
            kept.append(c)
            continue
        near["merged_from"] += 1
        lo, hi = min(near["start_idx"], c["start_idx"]), max(near["end_idx"], c["end_idx"])
        if share < ceiling and end[hi] - start[lo] <= longest:
            near.update(start_idx=lo, end_idx=hi, start=float(start[lo]), end=float(end[hi]), source="merged")
            near["scores"] = {k: max(v, c["scores"].get(k, 0.0)) for k, v in near["scores"].items()}
            near["overall"], near["heuristic"] = max(near["overall"], c["overall"]), max(near["heuristic"], c["heuristic"])
        for k in ("reason", "title"):
            near[k] = near.get(k) or c.get(k, "")
        near["confidence"] = max(near["confidence"], 0.9 * c["confidence"])
    return sorted(kept, key=lambda c: -c["overall"])


def top_up(clips: list[dict], pool: list[dict], want: int, share: float = 0.05) -> list[dict]:
    """Add clips of the pool, in order, that overlap nothing accepted so far, until there are `want`."""
    out = list(clips)
    for c in pool:
        if len(out) >= want:
            break
        if all(overlap(c, x) <= share for x in out):
            out.append(c)
    return out


def similarity(a: dict, b: dict, duration: float) -> float:
    apart = abs((a["start"] + a["end"]) - (b["start"] + b["end"])) / 2
    return min(1.0, (0.55 if a["clip_type"] == b["clip_type"] else 0.0) + 0.45 * max(0.0, 1.0 - apart / (max(1.0, duration) * 0.25)))


def select(clips: list[dict], target: int, duration: float, lam: float = 0.7, min_gap: float = 5.0) -> list[dict]:
    """Maximal marginal relevance: the best first, then the best of quality less likeness, away from all chosen; ranks by overall.

    Likeness only grows with what is chosen, so a value worked out earlier is an upper bound: clips wait in a heap by that
    bound, and only the one on top is brought up to date, until the top already is.  Equal values go by overall order.
    """
    pool = sorted(clips, key=lambda c: -c["overall"])
    lam = min(1.0, max(0.0, lam))
    chosen = pool[:1]

    def value(c, likeness):
        return lam * c["overall"] / 100.0 - (1.0 - lam) * likeness

    heap = [(-value(c, 0.0), k, 0, 0.0) for k, c in enumerate(pool) if k]
    heapq.heapify(heap)
    while heap and len(chosen) < target:
        _, k, seen, likeness = heap[0]
        if seen == len(chosen):
            heapq.heappop(heap)
            chosen.append(pool[k])
            continue
        c, new = pool[k], chosen[seen:]
        if any(overlap(c, x) > 0.05 or (c["start"] < x["end"] + min_gap and x["start"] < c["end"] + min_gap) for x in new):
            heapq.heappop(heap)  # what clashes once clashes for good
            continue
        likeness = max(likeness, *(similarity(c, x, duration) for x in new))
        heapq.heapreplace(heap, (-value(c, likeness), k, len(chosen), likeness))
    chosen.sort(key=lambda c: -c["overall"])
    return [{**c, "rank": n} for n, c in enumerate(chosen, 1)]


def fit_duration(s: dict, i: int, j: int, low: float, high: float) -> tuple[int, int] | None:
    """Grow towards the smaller pause until long enough, then trim from the weaker end until short enough; null if still far outside."""
    n = len(s["start"])
    i, j = sorted((min(n - 1, max(0, i)), min(n - 1, max(0, j))))
    span = lambda: s["end"][j] - s["start"][i]
    for _ in range(400):
        if span() >= low or (i == 0 and j == n - 1):
            break
        if i == 0 or (j < n - 1 and s["pause_after"][j] <= s["pause_before"][i]):
            j += 1
        else:
            i -= 1
    for _ in range(400):
        if span() <= high or i >= j:
            break
        if s["pause_before"][j] >= s["pause_after"][i]:
            j -= 1
        else:
            i += 1
    return None if span() < 0.6 * low or span() > 1.35 * high else (i, j)


def trim_edges(s: dict, i: int, j: int, low: float, tail_flags, head_flags, most: int = 3) -> tuple[int, int]:
    """Drop up to `most` fillers or transitions off the tail and fillers off the head, never below `low` seconds."""
    for _ in range(most):
        if j > i and tail_flags[j] and s["end"][j - 1] - s["start"][i] >= low:
            j -= 1
        else:
            break
    for _ in range(most):
        if i < j and head_flags[i] and s["end"][j] - s["start"][i + 1] >= low:
            i += 1
        else:
            break
    return i, j


def by_group(rows: DataFrame, group: str, of, schema) -> DataFrame:
    """of(a group's rows as dicts) -> rows, for rows that lie sorted with each group in one partition: one pass over the partition, where a call of Spark's for each group costs milliseconds."""
    names, out = rows.columns, [f.name for f in schema.fields]
    types = to_arrow_schema(schema)
    key = names.index(group)

    def packed(done):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], types.field(c).type, from_pandas=True) for c in out], names=out)

    def run(batches):
        mine, done = [], []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in batch.columns]  # a null number is nan, as it is to pandas
            for r in zip(*columns):
                if mine and mine[0][key] != r[key]:
                    done += of([dict(zip(names, x)) for x in mine])
                    mine = []
                    if len(done) >= 1 << 13:
                        yield packed(done)
                        done = []
                mine.append(r)
        if mine:
            done += of([dict(zip(names, x)) for x in mine])
        if done:
            yield packed(done)

    return rows.mapInArrow(run, schema)


def _pool(rows: list[dict]) -> list[dict]:
    return [{**r, "scores": {k: r[k] for k in scoring.CATEGORY_MAX if k in r}} for r in rows]


def dedupe_rows(clips: DataFrame, group: str, iou: float = 0.4, longest: float = 90.0, ceiling: float = 0.75) -> DataFrame:
    """dedupe over rows (group, pos, start_idx, end_idx, start, end, overall, heuristic, confidence, clip_type, source, merged_from, some of the six scores), pos the order of equal clips; a group is a pool, which the caller has capped."""

    def of(rows):
        start, end = {r["start_idx"]: r["start"] for r in rows}, {r["end_idx"]: r["end"] for r in rows}
        return [{**c, **c["scores"]} for c in dedupe(_pool(rows), start, end, iou, longest, ceiling)]

    return by_group(clips.repartition(F.col(group)).sortWithinPartitions(group, "pos"), group, of, clips.schema)


def mmr_rows(clips: DataFrame, group: str, target: int = 12, lam: float = 0.7, min_gap: float = 5.0) -> DataFrame:
    """select over rows (group, pos, start, end, overall, clip_type, duration), pos the order of equal clips, with `rank`; a group is a pool, which the caller has capped."""
    schema = clips.withColumn("rank", F.lit(0)).schema
    return by_group(clips.repartition(F.col(group)).sortWithinPartitions(group, "pos"), group, lambda rows: select(_pool(rows), target, rows[0]["duration"], lam, min_gap), schema)


def fit_rows(built: DataFrame, spans: str, low: float = 20.0, high: float = 90.0) -> DataFrame:
    """(transcript_id, start_idx, end_idx, fit_start, fit_end, trim_start, trim_end) of rows with sentences and an array column of spans {start_idx, end_idx}: fitted to the length band (null: cannot be), then with fillers and transitions off its ends."""
    names = ["transcript_id", "start_idx", "end_idx", "fit_start", "fit_end", "trim_start", "trim_end"]
    flags = [F.transform("sentences", lambda s: T.is_transition(s["text"]) | T.is_filler(s["text"])).alias("_tail"), F.transform("sentences", lambda s: T.is_filler(s["text"])).alias("_head")]
    fields = [F.col(f"sentences.{c}").alias(f"_{c}") for c in ("start", "end", "pause_before", "pause_after")]

    def run(frames):
        for f in frames:
            rows = []
            for tid, tail, head, start, end, before, after, wanted in f.itertuples(index=False):
                s = {"start": start, "end": end, "pause_before": before, "pause_after": after}
                for w in wanted if len(start) else ():
                    got = fit_duration(s, w["start_idx"], w["end_idx"], low, high)
                    cut = trim_edges(s, *got, low, tail, head) if got else (None, None)
                    rows.append((tid, w["start_idx"], w["end_idx"], *(got or (None, None)), *cut))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names[1:]})

    return built.select("transcript_id", *flags, *fields, spans).mapInPandas(run, "transcript_id string, " + ", ".join(f"{c} int" for c in names[1:]))


def padded(s: dict, i: int, j: int, lead: float = 0.25, tail: float = 0.40) -> tuple[float, float]:
    return max(0.0, s["start"][i] - min(lead, 0.6 * s["pause_before"][i])), s["end"][j] + min(tail, 0.6 * max(0.0, s["pause_after"][j]))


def finish(ready: DataFrame, o: dict | None = None) -> DataFrame:
    """The whole offline path: windows, offline scores, cap, merge, varied set, edge trimming, padding, virality; one pass over transcripts, no shuffle."""
    o = CLIPS | (o or {})
    kinds = schemas.CLIP + ", virality double, title string, hook_line string, text string"
    names, arrow = [c.split()[0] for c in kinds.split(", ")], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema, white = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in kinds.split(", ")]), o["white"]

    def run(batches):
        for batch in batches:
            for lo, some in segment.transcripts_of(batch, 2, WN.TOGETHER):
                part = batch.slice(lo, some)
                t = WN.Together(part, 2, white)
                s, rows = t.scorer.s, {c: [] for c in names}
                found = [w[: o["max_candidates"]] for w in t.candidates(o["min_duration"], o["max_duration"])]
                pools = iter(offlines(t.scorer, [w for ws in found for w in ws], o.get("weights") or scoring.CATEGORY_MAX))
                for tid, duration, ws, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found, t.cut[:-1].tolist()):
                    merged = dedupe([next(pools) for _ in ws], s["start"], s["end"], o["iou"], o["max_duration"], o["merge_ceiling"])
                    for c in select(merged, o["target_count"], duration, o["lambda"], o["min_gap"]):
                        i, j = trim_edges(s, c["start_idx"], c["end_idx"], o["min_duration"], _Flags(s["text"], WN.is_tail), _Flags(s["text"], WN.is_filler))
                        a, b = padded(s, i, j)
                        body = " ".join(s["text"][i : j + 1]).strip(white.trims)
                        c = c | c["scores"] | {"transcript_id": tid, "start_idx": i - base, "end_idx": j - base, "start": a, "end": b, "virality": virality(c["scores"], c["clip_type"]), "title": (body.split(".")[0] or body)[:70].strip(white.trims), "hook_line": s["text"][i][:200], "text": body}
                        for k in names:
                            rows[k].append(c[k])
                yield from pa.table(rows, schema).to_batches()

    return ready.select("transcript_id", "duration", "sentences", "profiles", "topic").mapInArrow(run, kinds)


class _Flags:
    """A list of flags that are worked out when they are looked at."""

    def __init__(self, texts: list[str], of):
        self.texts, self.of = texts, of

    def __getitem__(self, k: int) -> bool:
        return self.of(self.texts[k])


# ---- relational pieces ---------------------------------------------------------


def type_breakdown(clips: DataFrame, by: str = "clip_type") -> DataFrame:
    return clips.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top_k(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def pick_ranks(clips: DataFrame, ranks: list[int]) -> DataFrame:
    return clips.where(F.col("rank").isin([int(r) for r in ranks]))


def compilation_pick(clips: DataFrame, most: int, group: str = "transcript_id") -> DataFrame:
    """The clips of a compilation: the most viral `most` (two at least) of each group, the overall score where there is no virality."""
    worth = F.coalesce(F.when(F.col("virality") != 0, F.col("virality")), F.col("overall"))
    return clips.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(worth), "rank"))).where(F.col("place") <= max(2, most))


def prune_jobs(jobs: DataFrame, keep: int = 12) -> DataFrame:
    """Jobs (id, status, finished_at) less the oldest finished ones beyond `keep`; jobs that still run stay.

    The finished jobs that stay are the newest `keep` less the running ones: a top-k over partitions, then a window over at most `keep` rows.
    """
    finished = F.col("status").isin("done", "error", "cancelled")
    newest = jobs.where(finished).orderBy(F.desc("finished_at"), F.desc("id")).limit(keep)
    newest = newest.withColumn("_place", F.row_number().over(W.orderBy(F.desc("finished_at"), F.desc("id"))))
    running = jobs.agg(F.count(F.when(~F.coalesce(finished, F.lit(False)), 1)).alias("_running"))
    stay = newest.crossJoin(F.broadcast(running)).where(F.col("_place") + F.col("_running") <= keep).select(*jobs.columns)  # one row
    return jobs.where(~F.coalesce(finished, F.lit(False))).unionByName(stay)


def rescored(pool: DataFrame, ranked: DataFrame, target: int) -> DataFrame:
    """pool (transcript_id, id, start, end, overall, confidence, merged_from, title, reason, clip_type, verdict) after a reply that compares its clips.

    ranked: transcript_id, pos, id, final_score, title, verdict, clip_type, absorbed (ids).  The first mention of a clip
    counts.  A clip is absorbed if another that overlaps it, or one the pool lacks, names it, unless it is among
    the first `target` itself; one named by a clip it does not overlap is demoted.  Mentioned clips blend the new score in
    (marks out of ten are scaled where the old score is over 20), the others lose a little, demoted ones more.
    """
    key = ["transcript_id", "id"]
    first = ranked.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("pos"))).where("_n = 1").drop("_n")
    spans = pool.select("transcript_id", "id", "start", "end", "merged_from")
    named = ranked.select("transcript_id", F.col("id").alias("by"), F.explode("absorbed").alias("id")).where(F.col("id") != F.col("by")).join(spans, key)
    by = spans.select("transcript_id", F.col("id").alias("by"), F.col("start").alias("b0"), F.col("end").alias("b1"))
    named = named.join(by, ["transcript_id", "by"], "left").withColumn("apart", F.coalesce(F.least("end", "b1") - F.greatest("start", "b0") <= 0, F.lit(False)))
    safe = ranked.where(F.col("pos") < target).select(*key).distinct()
    gone = named.where("not apart").join(safe, key, "left_anti")
    absorbed = gone.select(*key).distinct()
    demoted = named.where("apart").select(*key).distinct().withColumn("demoted", F.lit(True))
    # a clip takes over what its first mention names, if that is gone at all
    gain = first.select("transcript_id", F.col("id").alias("by"), F.explode("absorbed").alias("id")).join(spans.join(absorbed, key), key).groupBy("transcript_id", F.col("by").alias("id")).agg(F.sum("merged_from").alias("gain"))
    new = first.select(*key, F.lit(True).alias("seen"), F.col("final_score").alias("_f"), F.trim("title").alias("_t"), F.trim("verdict").alias("_v"), F.col("clip_type").alias("_k"))
    d = pool.join(absorbed, key, "left_anti").join(new, key, "left").join(gain, key, "left").join(demoted, key, "left")
    mark = F.coalesce("_f", "overall")
    mark = F.when((mark > 0) & (mark <= 10) & (F.col("overall") > 20), mark * 10).otherwise(mark)
    blended = F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.65 * mark + 0.35 * F.col("overall"))), 1)
    lesser = F.bround(F.col("overall") * F.when(F.col("demoted"), 0.80).otherwise(0.92), 1)
    seen = F.coalesce("seen", F.lit(False))
    say = seen & (F.col("_v") != "")
    out = {
        "overall": F.when(seen, blended).otherwise(lesser),
        "confidence": F.when(seen, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")),
        "merged_from": F.when(seen, F.col("merged_from") + F.coalesce("gain", F.lit(0))).otherwise(F.col("merged_from")).cast(dict(pool.dtypes)["merged_from"]),
        "title": F.when(seen & (F.length("_t") > 4), F.left("_t", F.lit(120))).otherwise(F.col("title")),
        "reason": F.when(say & (F.coalesce("reason", F.lit("")) == ""), F.col("_v")).otherwise(F.col("reason")),
        "verdict": F.when(say, F.left("_v", F.lit(400))).otherwise(F.col("verdict")),
        "clip_type": F.when(seen & (F.trim("_k") != ""), scoring.normalise_type(F.col("_k"))).otherwise(F.col("clip_type")),
    }
    return d.withColumns(out).select(*pool.columns)


def zigzag(rows: DataFrame, group: str, score: str, payoff: str, tie: str) -> DataFrame:
    """Retention order before swaps: the best first, the highest payoff of the rest last, the others alternating high and low."""
    g = W.partitionBy(group)
    d = rows.withColumn("_r", F.row_number().over(g.orderBy(F.desc(score), tie))).withColumn("_n", F.count(F.lit(1)).over(g))
    last = F.row_number().over(g.orderBy((F.col("_r") == 1).cast("int"), F.desc(payoff), F.desc(score), tie))
    d = d.withColumn("_last", (last == 1) & (F.col("_n") > 2) & (F.col("_r") > 1))
    mid = F.row_number().over(g.orderBy(((F.col("_r") == 1) | F.col("_last")).cast("int"), "_r"))
    m = F.col("_n") - 2
    d = d.withColumn("_m", mid)
    place = F.when(F.col("_n") <= 2, F.col("_r")).when(F.col("_r") == 1, 1).when(F.col("_last"), F.col("_n")).when(F.col("_m") <= F.ceil(m / 2), 2 * F.col("_m")).otherwise(2 * (m - F.col("_m") + 1) + 1)
    return d.withColumn("position", place.cast("long")).drop("_r", "_n", "_last", "_m")


def spread_types(types: list[str]) -> list[int]:
    """Order of positions after swapping forward the next clip of another type wherever two neighbours share one."""
    out = list(range(len(types)))
    for k in range(1, len(out)):
        if types[out[k]] == types[out[k - 1]]:
            other = next((x for x in range(k + 1, len(out)) if types[out[x]] != types[out[k - 1]]), None)
            if other is not None:
                out[k], out[other] = out[other], out[k]
    return out


def retention(rows: DataFrame, group: str, score: str, payoff: str, clip_type: str, tie: str) -> DataFrame:
    """zigzag, then type swaps in the middle; a group is one compilation and must fit a task."""
    z = zigzag(rows, group, score, payoff, tie)

    def of(pool):
        if len(pool) > 3:
            mid = pool[1:-1]
            pool = [pool[0], *[mid[k] for k in spread_types([r[clip_type] for r in mid])], pool[-1]]
        return [{**r, "position": k} for k, r in enumerate(pool, 1)]

    return by_group(z.repartition(F.col(group)).sortWithinPartitions(group, "position"), group, of, z.schema)


def normal_type(value) -> str:
    t = str(value or "other").strip().lower().replace(" ", "_").replace("-", "_")
    return t if t in scoring.CLIP_TYPES else next((of for alias, of in scoring.TYPE_ALIASES.items() if alias in t), "other")
