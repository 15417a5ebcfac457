"""Transcripts as rows of words against the operators that hold a transcript in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import shared
from spanloom.operators import captions, long, rank, segment, windows
from spanloom.plans import analyze

WORDS = "so the secret never money because wow I people imagine truth amazing learn love works house river green anyway yeah".split()


def transcript(r, tid, n, marks=0.1, pauses=0.03):
    t, out = 0.0, []
    for _ in range(n):
        w = r.choice(WORDS) + (r.choice(".!,?") if r.random() < marks else "")
        d = round(r.random() * 0.5 + 0.1, 2)
        out.append((t, t + d, w, 1.0))
        t = round(t + d + (r.choice([0.7, 1.2, 0.6]) if r.random() < pauses else 0.02), 2)
    return (tid, "fr" if tid == "b" else "en", t, out)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    # with and without marks and pauses: without, every sentence is cut by size and no two carries ever meet
    made = [transcript(r, "a", 2000), transcript(r, "b", 500), transcript(r, "c", 1500, 0, 0), transcript(r, "d", 3, 0), transcript(r, "e", 900, 0.3, 0.2), ("f", "en", 0.0, []), transcript(r, "g", 1)]
    return spark.createDataFrame(made, "transcript_id string, language string, duration double, words array<struct<start:double,end:double,text:string,prob:double>>")


@pytest.fixture(scope="module")
def words(rows):
    return rows.select("transcript_id", "language", F.explode("words").alias("w")).select("transcript_id", "language", "w.start", "w.end", "w.text").repartition(5)


@pytest.mark.parametrize("size", [100, 170])
def test_folds_over_chunks(spark, rows, words, monkeypatch, size):
    monkeypatch.setattr(long, "CHUNK", size)
    monkeypatch.setattr(long, "FAN", 3)
    tables = shared.Tables(spark)
    numbered = long.with_positions(words, ["start"], tables)
    assert numbered.groupBy("transcript_id").agg((F.max("pos") + 1 == F.count("*")).alias("ok"), F.countDistinct("pos").alias("n")).where("not ok").count() == 0
    cols = ["transcript_id", "idx", "start", "end", "text", "pause_before", "pause_after", "n_words"]
    got = sorted(map(tuple, long.pieces(numbered, long.Sentences(), tables).select(*cols).collect()))
    assert got == sorted(map(tuple, segment.explode(segment.build(rows)).select(*cols).collect()))
    got = sorted(map(tuple, long.pieces(numbered, long.Phrases(), tables).select("transcript_id", "idx", "start", "end", "text").collect()))
    assert got == sorted(map(tuple, captions.phrases(rows).select("transcript_id", "phrase", "start", "end", "text").collect()))


def test_windows_over_blocks(rows, words, monkeypatch):
    for name, v in (("CHUNK", 100), ("FAN", 4), ("TOPIC_BLOCK", 40), ("SCORE_BLOCK", 100.0), ("BLOCK", 400.0)):
        monkeypatch.setattr(long, name, v)
    show = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert show(long.windows(words)) == show(windows.windows(analyze.ready(rows)))
    assert long.windows(words.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suppression_in_rounds(spark, seed):
    """Many equal scores and long chains over the blocks' borders: the serial result, whatever the limit."""
    r = np.random.default_rng(seed)
    n = 1500
    start = np.sort(np.round(r.random(n) * 6000, 1))
    end = start + np.round(r.random(n) * 70 + 20, 1)
    score = np.round(r.random(n) * (5 if seed % 2 else 50)) if seed < 3 else np.arange(n, dtype=float)
    order = np.lexsort((np.arange(n), np.arange(n), score))[::-1]
    df = spark.createDataFrame([("t", i, i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(start, end, score))], "transcript_id string, start_idx long, end_idx long, start double, end double, score double").repartition(4)
    for limit in (20, 100_000):
        got = sorted(x.start_idx for x in long.suppress(df, shared.Tables(spark), 0.6, limit).collect())
        assert got == sorted(windows.suppress(start, end, order, 0.6, limit))


def test_lazy_greedy_is_the_plain_one():
    """The heap of bounds chooses what a full pass for each choice does."""

    def plain(clips, target, duration, lam, gap):
        pool = sorted(clips, key=lambda c: -c["overall"])
        chosen = pool[:1]
        while pool and len(chosen) < target:
            free = [c for c in pool if c not in chosen and all(rank.overlap(c, x) <= 0.05 and not (c["start"] < x["end"] + gap and x["start"] < c["end"] + gap) for x in chosen)]
            if not free:
                break
            chosen.append(max(free, key=lambda c: lam * c["overall"] / 100.0 - (1.0 - lam) * max(rank.similarity(c, x, duration) for x in chosen)))
        return [c["id"] for c in sorted(chosen, key=lambda c: -c["overall"])]

    r = random.Random(6)
    for _ in range(60):
        n = r.randint(0, 40)
        clips = [{"id": i, "start": (s := r.random() * 900), "end": s + r.random() * 60 + 5, "overall": float(r.choice([40, 50, 60, r.randint(0, 100)])), "clip_type": r.choice("abc")} for i in range(n)]
        lam = r.choice([0.0, 0.3, 0.7, 1.0])
        assert [c["id"] for c in rank.select(clips, 8, 1000.0, lam, 5.0)] == plain(clips, 8, 1000.0, lam, 5.0)


def test_runs_own_their_tables(spark):
    a, b = shared.Tables(spark), shared.Tables(spark)
    x, y = a.stored(spark.range(3), "x"), b.stored(spark.range(4), "y")
    a.drop(x, y)
    assert y.count() == 4 and not a.at and len(b.at) == 1
