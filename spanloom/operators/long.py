"""Transcripts of any length, as rows: folds over chunks of words, scores over blocks, suppression in rounds.

The array operators hold a transcript in one task.  Here a transcript is rows of words, and no task holds more of it
than a chunk:

* a fold (sentences, phrases) is a map on its state at a chunk's border, the words since the open piece began, of
  which there are at most `reach`.  Chunks work out their maps in parallel, maps compose in order, and with the states known
  chunks cut their pieces in parallel;
* windows are scored in blocks of time with the sentences after them that windows reach;
* greedy suppression runs in rounds of blocks: a block decides every window whose better neighbours it holds, what
  hangs on windows beyond its borders waits for the next round, whose blocks are shifted by half.

Results are those of segment.build, captions.phrases and windows.windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import shared
from spanloom.functions import lexicon
from spanloom.functions import text as T
from spanloom.operators import captions, segment
from spanloom.operators import windows as WN

#: Words of a chunk, chunks whose maps one task composes, sentences of a topic block, seconds of a scoring block and of a suppression block.
CHUNK, FAN, TOPIC_BLOCK, SCORE_BLOCK, BLOCK = 2000, 1000, 500, 600.0, 1800.0


class Sentences:
    """The fold of segment.sentence_ranges: a piece that is open has fewer words than the most, plus what a cut at a clause mark leaves."""

    def __init__(self, o: segment.Options = segment.Options()):
        self.o, self.reach = o, o.max_words

    def closings(self, start, end, text, begin, scan):
        return segment.closings(start, end, text, self.o, begin, scan)

    def text(self, words):
        return segment.sentence_text(words)


class Phrases:
    """The fold of captions.phrase_starts."""

    def __init__(self, max_words: int = 4, longest: float = 2.4, gap: float = captions.GAP_BREAK, max_chars: int = 0):
        self.o, self.reach = (max_words, longest, gap, max_chars), max_words

    def closings(self, start, end, text, begin, scan):
        at = captions.phrase_starts(start, end, text, *self.o, first=begin)
        return ((a, b - 1, b) for a, b in zip(at, at[1:]))

    def text(self, words):
        return " ".join(words)


def with_positions(words: DataFrame, order: list[str], tables: shared.Tables) -> DataFrame:
    """words with `pos`, counted from zero in each transcript by `order` (ties in any order): ranges are numbered by themselves and shifted by what lies before them."""
    ranged = words.repartitionByRange(words.sparkSession.sparkContext.defaultParallelism * 2, "transcript_id", *order).sortWithinPartitions("transcript_id", *order)
    m = F.monotonically_increasing_id()
    rows = tables.stored(ranged.withColumns({"_part": F.shiftright(m, 33), "_row": m}), "words")
    runs = rows.groupBy("transcript_id", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each range of a transcript
    before = F.coalesce(F.sum("_n").over(W.partitionBy("transcript_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_shift", before - F.col("_first")).select("transcript_id", "_part", "_shift")
    return rows.join(runs, ["transcript_id", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def pieces(words: DataFrame, fold, tables: shared.Tables) -> DataFrame:
    """Pieces of words (transcript_id, language, pos, start, end, text): idx, first and last word, times, text, pauses as segment.sentences has them, n_words."""
    reach = fold.reach
    chunk, at = F.floor(F.col("pos") / CHUNK), F.col("pos") % CHUNK
    also = F.array(chunk, F.when(at >= CHUNK - reach - 1, chunk + 1), F.when((at == 0) & (chunk > 0), chunk - 1))
    held = words.select("transcript_id", "language", "pos", "start", "end", "text", F.explode(F.array_compact(also)).alias("chunk"))

    def opened(pdf: pd.DataFrame):
        """A chunk's words as lists, the position of the first, where its own begin and end, whether it is the last."""
        pdf = pdf.sort_values("pos")
        k, low = int(pdf["chunk"].iloc[0]), int(pdf["pos"].iloc[0])
        lo, hi = k * CHUNK - low, min((k + 1) * CHUNK - low, len(pdf))
        return pdf["start"].tolist(), pdf["end"].tolist(), pdf["text"].tolist(), low, lo, hi, hi == len(pdf)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        start, end, text, _, lo, hi, _ = opened(pdf)
        if lo >= hi:  # no words of its own
            return pd.DataFrame(columns=["transcript_id", "chunk", "carry", "n"])
        known: dict[tuple[int, int], tuple[int, int]] = {}  # state: carry at the border, pieces closed until then
        out = []
        for c in range(min(reach, lo) + 1):
            path, state = [], (lo - c, lo)
            for _, m, i in fold.closings(start, end, text, lo - c, lo):
                if i >= hi or state in known:
                    break
                path.append(state)
                state = (m + 1, i + 1)
            carry, n = known.get(state, (hi - state[0], 0))
            known[state] = carry, n
            for back, s in enumerate(reversed(path), 1):
                known[s] = carry, n + back
            out.append(known[lo - c, lo])
        return pd.DataFrame({"transcript_id": [pdf["transcript_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "carry": [[c for c, _ in out]], "n": [[n for _, n in out]]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One map for a run of chunks."""
        carry = n = None
        for c, m in pdf.sort_values("chunk")[["carry", "n"]].itertuples(index=False):
            n = list(m) if n is None else [a + m[b] for a, b in zip(n, carry)]
            carry = list(c) if carry is None else [c[b] for b in carry]
        return pd.DataFrame({"transcript_id": [pdf["transcript_id"].iloc[0]], "run": [pdf["run"].iloc[0]], "carry": [carry], "n": [n]})

    def through(pdf: pd.DataFrame, by: str, c: int = 0, n: int = 0) -> pd.DataFrame:
        """The state that each map of a sequence meets."""
        pdf = pdf.sort_values(by)
        met = []
        for carry, count in pdf[["carry", "n"]].itertuples(index=False):
            met.append((c, n))
            c, n = int(carry[c]), n + int(count[c])
        return pd.DataFrame({"transcript_id": pdf["transcript_id"], by: pdf[by], "c": [x for x, _ in met], "before": [x for _, x in met]})

    def within(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return through(own, "chunk", int(state["c"].iloc[0]), int(state["before"].iloc[0]))

    names = ["transcript_id", "language", "idx", "first", "last", "start", "end", "text", "pause_before", "pause_after", "n_words"]

    def cut(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=names)
        start, end, text, low, lo, hi, last = opened(pdf)
        c, idx = int(state["c"].iloc[0]), int(state["before"].iloc[0])
        found, begin = [], lo - c
        for a, m, i in fold.closings(start, end, text, begin, lo):
            if i >= hi:
                break
            found.append((a, m))
            begin = m + 1
        if last and begin < hi:
            found.append((begin, hi - 1))
        tid, language, rows = pdf["transcript_id"].iloc[0], pdf["language"].iloc[0], []
        for k, (a, m) in enumerate(found):
            body = fold.text(text[a : m + 1])
            before = round(start[a] - end[a - 1], 3) if a + low else start[a]
            after = round(start[m + 1] - end[m], 3) if m + 1 < len(text) else 2.0
            rows.append((tid, language, idx + k, a + low, m + low, start[a], end[m], body, max(0.0, before), max(0.0, after), len(segment.split(body))))
        return pd.DataFrame(rows, columns=names)

    key = ["transcript_id", "chunk"]
    grouped = held.groupBy(*key)
    known = tables.stored(grouped.applyInPandas(maps, "transcript_id string, chunk long, carry array<int>, n array<long>").withColumn("run", F.floor(F.col("chunk") / FAN)), "fold-maps")
    runs = known.groupBy("transcript_id", "run").applyInPandas(compose, "transcript_id string, run long, carry array<int>, n array<long>")
    entry = runs.groupBy("transcript_id").applyInPandas(lambda pdf: through(pdf, "run"), "transcript_id string, run long, c int, before long")
    states = known.groupBy("transcript_id", "run").cogroup(entry.groupBy("transcript_id", "run")).applyInPandas(within, "transcript_id string, chunk long, c int, before long")
    schema = "transcript_id string, language string, idx long, first long, last long, start double, end double, text string, pause_before double, pause_after double, n_words int"
    return grouped.cogroup(states.groupBy(*key)).applyInPandas(cut, schema)


def profiled(sents: DataFrame) -> DataFrame:
    """sents with a column for each signal score, by the language's rules."""
    cats = (*lexicon.CATEGORIES, "weak_start")

    def of(rules, c):
        return T.rule_score(T.bare(F.col("text")), rules[c])

    def score(c):
        out = of(lexicon.EN, c)
        for code, rules in lexicon.LANGUAGES.items():
            if code != "en":
                out = F.when(F.substring("language", 1, 2) == code, of(rules, c)).otherwise(out)
        return out

    return sents.withColumns({c: score(c) for c in cats})


def with_topic(sents: DataFrame, window: int = 6) -> DataFrame:
    """sents with `topic`: segment.topic_shift in blocks that also hold the sentences `window` beyond their borders."""
    block, at = F.floor(F.col("idx") / TOPIC_BLOCK), F.col("idx") % TOPIC_BLOCK
    also = F.array(block, F.when(at >= TOPIC_BLOCK - window, block + 1), F.when((at < window) & (block > 0), block - 1))
    rows = sents.select("transcript_id", "idx", "text", block.alias("_own"), F.explode(F.array_compact(also)).alias("_block"))
    rows = rows.withColumn("_key", F.struct("transcript_id", "_block"))
    shift = segment.topic_shift(rows, "_key", "idx", window=window, normalise=False).where("_own = _block").select("transcript_id", "idx", "shift")
    top = shift.groupBy("transcript_id").agg(F.max("shift").alias("_top"))
    scaled = F.round(F.col("shift") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0), 3)
    return sents.join(shift.join(top, "transcript_id").select("transcript_id", "idx", scaled.alias("topic")), ["transcript_id", "idx"])


_WINDOW = "transcript_id string, start_idx long, end_idx long, start double, end double, score double"


def scored(sents: DataFrame, low: float = 20.0, high: float = 90.0) -> DataFrame:
    """Every window of low..high seconds with its score, of sentence rows with profiles and topic; ends are taken as non-decreasing."""
    block = F.floor(F.col("start") / SCORE_BLOCK)
    # a sentence is in its own block and in those of windows that began up to `high` seconds before its end
    first = F.greatest(F.lit(0), F.floor((F.col("start") - high) / SCORE_BLOCK))
    rows = sents.withColumn("_block", F.explode(F.sequence(F.least(first, block), block)))
    cats = (*lexicon.CATEGORIES, "weak_start")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        s = {c: pdf[c].to_numpy(float) for c in ("start", "end", "pause_before", "pause_after", "n_words")} | {"text": pdf["text"].tolist()}
        p = {c: pdf[c].to_numpy(float) for c in cats}
        sc = WN.Scorer(s, p, pdf["topic"].to_numpy(float))
        i, j = WN.in_band(s["start"], s["end"], p["weak_start"], low, high)
        own = np.floor(s["start"][i] / SCORE_BLOCK) == pdf["_block"].iloc[0]
        i, j = i[own], j[own]
        idx = pdf["idx"].to_numpy()
        return pd.DataFrame({"transcript_id": pdf["transcript_id"].iloc[0], "start_idx": idx[i], "end_idx": idx[j], "start": s["start"][i], "end": s["end"][j], "score": sc.score(i, j)})

    return rows.groupBy("transcript_id", "_block").applyInPandas(run, _WINDOW)


def decide(start: np.ndarray, end: np.ndarray, order: np.ndarray, kept: np.ndarray, risk: np.ndarray, iou: float, reach: float) -> np.ndarray:
    """1 kept, 0 gone, -1 open, for windows in order of start.

    `order` lists the undecided, best first; `kept` marks those kept before; at `risk` are windows with neighbours elsewhere.
    A window goes if a kept one overlaps it by more than iou, is kept if nothing better that overlaps it is open, and else stays open.
    """
    state = np.where(kept, 1, -1).astype(np.int8)
    gone, doubt = np.zeros(len(start), bool), risk.copy()

    def near(k):
        a, b = np.searchsorted(start, start[k] - reach, "left"), np.searchsorted(start, start[k] + reach, "right")
        inter = np.maximum(0.0, np.minimum(end[k], end[a:b]) - np.maximum(start[k], start[a:b]))
        hull = np.maximum(end[k], end[a:b]) - np.minimum(start[k], start[a:b])
        return a + np.flatnonzero((hull > 0) & (inter > iou * hull) & (inter / np.where(hull > 0, hull, 1.0) > iou))

    for k in np.flatnonzero(kept):
        gone[near(k)] = True
    for k in order:
        if gone[k]:
            continue
        if doubt[k]:
            doubt[near(k)] = True
        else:
            state[k] = 1
            gone[near(k)] = True
    state[gone & ~kept & (state < 1)] = 0
    return state


def suppress(rows: DataFrame, tables: shared.Tables, iou: float = 0.6, limit: int = 400, high: float = 90.0, most_rounds: int = 200) -> DataFrame:
    """The `limit` best windows that survive greedy suppression in each transcript, as windows.suppress keeps them.

    Windows last `high` seconds at most, so those that overlap by more than iou begin less than `reach` apart.  In every
    second round the best undecided window lies away from its block's borders, so each two rounds decide some; in
    practice three or four decide all.
    """
    reach = (1.0 - iou) * high / iou
    if not 0 < iou < 1 or 4 * reach >= BLOCK:
        raise ValueError("overlap share and lengths need blocks of several reaches")

    def run(shift):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("start", kind="stable").reset_index(drop=True)
            a, b = pdf["start"].to_numpy(), pdf["end"].to_numpy()
            kept = pdf["kept"].to_numpy(bool)
            lo = (np.floor((a + shift) / BLOCK) * BLOCK) - shift
            risk = (a - lo <= reach) & (lo > 0) | (lo + BLOCK - a <= reach)
            order = np.lexsort((pdf["end_idx"], pdf["start_idx"], pdf["score"]))[::-1]
            state = decide(a, b, order[~kept[order]], kept, risk & ~kept, iou, reach)
            return pdf.assign(kept=state == 1)[state != 0].drop(columns="_block")

        return of

    table = tables.stored(rows.select("transcript_id", "start_idx", "end_idx", "start", "end", "score").withColumn("kept", F.lit(False)), "windows")
    for r in range(most_rounds):
        shift = BLOCK / 2 * (r % 2)
        blocked = table.withColumn("_block", F.floor((F.col("start") + shift) / BLOCK))
        new = tables.stored(blocked.groupBy("transcript_id", "_block").applyInPandas(run(shift), _WINDOW + ", kept boolean"), "windows")
        tables.drop(table)
        table = new
        if table.where("not kept").isEmpty():
            break
    else:
        raise RuntimeError("windows are still undecided")
    place = F.row_number().over(W.partitionBy("transcript_id").orderBy(F.desc("score"), F.desc("start_idx"), F.desc("end_idx")))
    return table.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place", "kept")


def dominant(found: DataFrame, sents: DataFrame) -> DataFrame:
    """found with `clip_type`: the type of the strongest category over a window's sentences."""
    keys = found.select("transcript_id", "start_idx", "end_idx", F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    each = keys.join(sents.select("transcript_id", "idx", F.array(*lexicon.CATEGORIES).alias("_v")), ["transcript_id", "idx"])
    g = each.groupBy("transcript_id", "start_idx", "end_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "_v"))).alias("_l"))
    zero = F.array(*[F.lit(0.0)] * len(lexicon.CATEGORIES))
    total = F.aggregate("_l", zero, lambda acc, x: F.zip_with(acc, x["_v"], lambda a, b: a + b))
    g = g.withColumn("_t", total).withColumn("_top", F.array_max("_t"))
    kinds = F.create_map(*[F.lit(x) for k, c in enumerate(lexicon.CATEGORIES, 1) for x in (k, lexicon.TYPE_OF[c])])
    kind = F.when(F.col("_top") > 0.6, F.element_at(kinds, F.array_position("_t", F.col("_top")).cast("int"))).otherwise("other")
    return found.join(g.select("transcript_id", "start_idx", "end_idx", kind.alias("clip_type")), ["transcript_id", "start_idx", "end_idx"])


def windows(words: DataFrame, order: list[str] | None = None, low: float = 20.0, high: float = 90.0, iou: float = 0.6, limit: int = 400) -> DataFrame:
    """Suppressed windows of rows of words (transcript_id, language, start, end, text), whatever the length of a transcript."""
    tables = shared.Tables(words.sparkSession)
    numbered = with_positions(words, order or ["start"], tables)
    sents = tables.stored(with_topic(tables.stored(profiled(pieces(numbered, Sentences(), tables)), "sentences")), "sentences")
    found = suppress(scored(sents, low, high), tables, iou, limit, high)
    return dominant(found, sents).select("transcript_id", "start_idx", "end_idx", "start", "end", "score", "clip_type")
