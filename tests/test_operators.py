"""Order-dependent operators against brute-force versions, golden cases and properties."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom import config
from spanloom.functions import lexicon, register, scoring
from spanloom.operators import camera, captions, insights, intervals, models, rank, segment, trimming, windows
from spanloom.plans import analyze, queries
from spanloom.sinks import exports
from spanloom.sources import media, transcripts


def clip(a, b, score=50.0, kind="story", **more):
    return {"start": float(a), "end": float(b), "start_idx": a, "end_idx": b, "overall": float(score), "heuristic": 1.0, "confidence": 0.5, "clip_type": kind, "scores": {"hook": 1.0}, "source": "llm", "merged_from": 1, "title": "", "reason": "", **more}


def transcript(seed, n=60):
    r = random.Random(seed)
    start, end, words, t = [], [], [], 0.0
    for _ in range(n * 8):
        t += r.choice([0.0, 0.05, 0.2, 0.7, 1.2]) if r.random() < 0.3 else 0.02
        d = r.uniform(0.1, 0.5)
        start.append(t)
        end.append(t + d)
        words.append(r.choice(["well", "nobody", "knows", "the", "truth,", "is", "amazing!", "and", "then", "it", "ended.", "so", "Mr.", "because;", "love"]))
        t += d
    return np.array(start), np.array(end), words


def test_sentences_golden():
    w = [(0, 0.2, "So"), (0.25, 0.3, "I"), (0.35, 0.8, "quit."), (1, 1.3, "Why?"), (2.6, 3, "Because"), (4.5, 4.8, "yes")]
    s = segment.sentences(np.array([x[0] for x in w], float), np.array([x[1] for x in w], float), [x[2] for x in w])
    assert s["text"] == ["So I quit. Why?", "Because yes"] and s["start"].tolist() == [0, 2.6] and s["end"].tolist() == [1.3, 4.8]
    assert s["pause_before"].tolist() == [0, 1.3] and s["pause_after"].tolist() == [1.3, 2.0]


@pytest.mark.parametrize("seed", range(4))
def test_sentences_cover_all_words_in_order(seed):
    a, b, w = transcript(seed)
    r = segment.sentence_ranges(a.tolist(), b.tolist(), w)
    assert [i for x, y in r for i in range(x, y + 1)] == list(range(len(w))) and all(y - x < 48 for x, y in r)


def test_long_run_is_cut_at_a_clause_mark():
    words = ["w"] * 44 + ["clause,"] + ["w"] * 20
    r = segment.sentence_ranges([i * 0.1 for i in range(65)], [(i + 1) * 0.1 for i in range(65)], words)
    assert r[0] == (0, 44) and segment.sentence_ranges([], [], []) == []


def test_blocks_golden():
    s = np.arange(5) * 60.0
    assert segment.blocks(s, s + 60, 150, 45) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    b = segment.blocks(np.arange(300) * 5.0, np.arange(300) * 5.0 + 5, 420, 45)
    assert all(x[0] < y[0] <= x[1] + 1 for x, y in zip(b, b[1:])) and b[-1][1] == 299


def _scorer(seed):
    a, b, w = transcript(seed)
    s = segment.sentences(a, b, w)
    r = np.random.default_rng(seed)
    p = {c: r.choice([0.0, 0.3, 0.8], len(s["text"])) for c in (*lexicon.CATEGORIES, "weak_start")}
    return windows.Scorer(s, p, r.random(len(s["text"])))


@pytest.mark.parametrize("seed", range(3))
def test_window_features_equal_a_plain_loop(seed):
    sc = _scorer(seed)
    s, p = sc.s, sc.p
    i, j = windows.in_band(s["start"], s["end"], p["weak_start"], 10, 40)
    n = len(s["text"])
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(n) for y in range(x, n) if p["weak_start"][x] < 0.95 and 10 <= s["end"][y] - s["start"][x] <= 40}
    f = sc.parts(i, j)
    for k in range(0, len(i), 7):
        a, b = i[k], j[k]
        size = b - a + 1
        top = lambda c, x, y: max(p[c][x : y + 1])
        head = min(b, a + 2)
        hook = max(top("hook", a, head), 0.6 * top("curiosity", a, head), 0.5 * top("opinion", a, head)) * (1 - 0.45 * p["weak_start"][a]) + 0.15 * sc.topic[a]
        tail = min(b, a + max(1, int(size * 0.55)))
        payoff = max(top("payoff", tail, b), 0.75 * top("value", tail, b), 0.6 * top("emotion", tail, b))
        cur = max(top("curiosity", a, min(b, a + int(size * 0.7))), 0.5 * top("story", a, b))
        emo = 0.7 * top("emotion", a, b) + 0.3 * np.mean(p["emotion"][a : b + 1])
        assert [f[c][k] for c in ("hook", "payoff", "curiosity", "emotion")] == pytest.approx([min(1, hook), min(1, payoff), min(1, cur), min(1, emo)])


@pytest.mark.parametrize("seed", range(3))
def test_suppression_equals_brute_force(seed):
    sc = _scorer(seed)
    got = windows.candidates(sc, 10, 40)
    i, j = windows.in_band(sc.s["start"], sc.s["end"], sc.p["weak_start"], 10, 40)
    kept = []
    for v, a, b in sorted(zip(sc.score(i, j).tolist(), i.tolist(), j.tolist()), reverse=True):
        c = {"start": sc.s["start"][a], "end": sc.s["end"][b]}
        if all(rank.overlap(c, {"start": sc.s["start"][x], "end": sc.s["end"][y]}) <= 0.6 for _, x, y in kept):
            kept.append((v, a, b))
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in kept[:400]]


def test_dedupe_golden():
    start = end = np.arange(200.0)
    same = rank.dedupe([clip(80, 120, 60), clip(84, 128, 50)], start, end)
    assert len(same) == 1 and (same[0]["start"], same[0]["end"]) == (80, 120) and same[0]["merged_from"] == 2
    wide = rank.dedupe([clip(80, 120, 60), clip(89, 135, 50)], start, end)
    assert (wide[0]["start"], wide[0]["end"], wide[0]["source"]) == (80, 135, "merged")
    assert len(rank.dedupe([clip(0, 40), clip(60, 100)], start, end)) == 2 and rank.dedupe([], start, end) == []


def test_select_golden():
    got = rank.select([clip(0, 40, 90, "story"), clip(100, 140, 88, "story"), clip(300, 340, 80, "opinion")], 2, 600, 0.7, 5)
    assert [c["overall"] for c in got] == [90, 80] and [c["rank"] for c in got] == [1, 2]
    r = random.Random(1)
    many = [clip(a, a + r.randint(5, 30), r.uniform(0, 100), r.choice("ab")) for a in range(0, 900, 7)]
    out = rank.select(many, 12, 900.0)
    assert all(rank.overlap(x, y) <= 0.05 and (x["start"] >= y["end"] + 5 or y["start"] >= x["end"] + 5) for x in out for y in out if x is not y)


def test_second_pass(spark):
    pool = [clip(0, 40, 80), clip(10, 45, 70), clip(100, 140, 60), clip(200, 240, 50)]
    rows = [("t", n, c["start"], c["end"], float(c["overall"]), 0.5, 1, "", "", "story", "") for n, c in enumerate(pool, 1)]
    p = spark.createDataFrame(rows, "transcript_id string, id int, start double, end double, overall double, confidence double, merged_from int, title string, reason string, clip_type string, verdict string")
    replied = spark.createDataFrame([("t", '{"ranked": [{"id": 1, "final_score": 9, "absorbed": [2, 3], "title": "A new title", "clip_type": "twist"}, {"id": 99}]}'), ("u", "no json")], "transcript_id string, reply string")
    out = sorted(rank.rescored(p, models.read_ranking(replied), 2).collect(), key=lambda c: -c.overall)
    assert [c.overall for c in out] == [86.5, 48.0, 46.0] and out[0].merged_from == 2 and out[0].clip_type == "reveal" and out[0].title == "A new title" and out[0].confidence == pytest.approx(0.6)


class Replies:
    """A model that proposes two moments of each block, leaves bounds alone and prefers the second finalist."""

    def complete(self, system, user, schema):
        if "candidates" in user:
            first = int(user.split("\n[")[1].split("]")[0])
            item = '{"start_index": %d, "end_index": %d, "hook": 20, "payoff": 20, "emotion": 10, "curiosity": 10, "standalone": 9, "editability": 9, "clip_type": "story", "suggested_title": "From the model", "confidence": 0.8}'
            return '{"candidates": [' + item % (first + 1, first + 4) + "," + item % (first + 9, first + 12) + "]}"
        return '{"ranked": [{"id": 2, "final_score": 99, "title": "The chosen one", "verdict": "best"}, {"id": 1, "final_score": 20}]}' if "ranked" in user else "I would not move it."


def test_plan_with_a_model(spark):
    text = " ".join(f"This is sentence number {i} and it goes on for a few more words here." for i in range(80))
    docs = spark.createDataFrame([(1, text, "en"), (2, "Too short.", "en"), (3, None, None)], "doc_id long, text string, lang string")
    t = transcripts.from_documents(docs)
    got = analyze.with_model(t, Replies(), {"wait": 0.0}).collect()
    top = next(r for r in got if r.rank == 1)
    assert {r.transcript_id for r in got} == {"1"} and top.title == "The chosen one" and top.verdict == "best" and top.source == "llm"
    assert sorted(r.rank for r in got) == list(range(1, len(got) + 1)) and all(r.end - r.start >= 19 for r in got)
    plain = {(r.start, r.end) for r in analyze.clips(t).collect()}
    assert {(r.start, r.end) for r in analyze.with_model(t, models.Offline()).collect()} == plain


class Counting(Replies):
    """Writes a line for each call."""

    def __init__(self, log):
        self.log = log

    def complete(self, system, user, schema):
        import hashlib

        with open(self.log, "a") as f:
            f.write(hashlib.sha1(user.encode()).hexdigest() + "\n")
        return super().complete(system, user, schema)


def test_the_model_is_asked_once(spark, tmp_path):
    """Whatever is evaluated again, no prompt is asked twice; a run on the same ledger asks nothing."""
    text = " ".join(f"This is sentence number {i} and it goes on for a few more words here." for i in range(80))
    docs = spark.createDataFrame([(i, f"{i} {text}", "en") for i in range(4)] + [(9, f"0 {text}", "en")], "doc_id long, text string, lang string")
    t = transcripts.from_documents(docs)
    log, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    first = analyze.with_model(t, Counting(str(log)), {"wait": 0.0}, ledger)
    want = sorted(map(str, first.collect()))
    calls = log.read_text().split()
    assert calls and len(calls) == len(set(calls))
    spark.catalog.clearCache()
    assert sorted(map(str, first.collect())) == want and log.read_text().split() == calls
    assert sorted(map(str, analyze.with_model(t, Counting(str(log)), {"wait": 0.0}, ledger).collect())) == want
    assert log.read_text().split() == calls
    # the ledger gives the same replies to another backend
    assert sorted(map(str, analyze.with_model(t, models.Offline(), {"wait": 0.0}, ledger).collect())) == want


def test_failed_prompts_are_asked_again_by_the_next_run(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    d = spark.createDataFrame([(1, "an apple"), (2, "a pear"), (3, "an apple"), (4, None)], "i int, prompt string")
    one = {r.i: r.reply for r in models.replies_once(d, models.Canned({"apple": "A"}), "s", ledger, wait=0.0).collect()}
    two = {r.i: r.reply for r in models.replies_once(d, models.Canned({"pear": "P"}), "s", ledger, wait=0.0).collect()}
    assert one == {1: "A", 2: None, 3: "A", 4: None} and two == {1: "A", 2: "P", 3: "A", 4: None}
    assert models.ledger_table(spark, ledger).count() == 2


def _clips(spark, ids):
    rows = [(t, 1, 10.0, 40.5, 77.25, "story", "A title, with a comma", "because\nso", "the text", *[9.0] * 6, 0.4, 60.0) for t in ids]
    return spark.createDataFrame(rows, "transcript_id string, rank int, start double, end double, overall double, clip_type string, title string, reason string, text string, hook double, payoff double, emotion double, curiosity double, standalone double, editability double, confidence double, virality double")


def test_reports_replace_only_their_own(spark, tmp_path):
    exports.write_reports(_clips(spark, [f"t{i}" for i in range(5)]), str(tmp_path / "out"))
    exports.write_reports(_clips(spark, ["t3"]), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "csv").glob("transcript_id=*")) == [f"transcript_id=t{i}" for i in range(5)]
    assert spark.read.text(str(tmp_path / "out" / "txt")).select("transcript_id").distinct().count() == 5
    text = exports.csv_document(_clips(spark, ["t"])).first().csv
    assert text.startswith("\ufeffrank,start,end,") and text.split("\n")[1].startswith('1,10.0,40.5,00:10,00:40,30.5,77.3,story,"A title, with a comma",because so,9.0') and text.endswith("\n")


def test_cache_folders(spark, tmp_path):
    for name in ("a", "b", "models", "thumbs"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text('{"n": 1}' if name != "b" else "{broken")
    got = transcripts.read_json_cache(spark, f"{tmp_path}/*/metadata.json", "n int").collect()
    assert sorted(r.transcript_id for r in got) == ["a", "models", "thumbs"] and {r.n for r in got} == {1}
    assert exports.clear_cache(spark, str(tmp_path), "b") == ["b"] and exports.clear_cache(spark, str(tmp_path), "models") == []
    assert exports.clear_cache(spark, str(tmp_path)) == ["a"] and sorted(p.name for p in tmp_path.iterdir()) == ["models", "thumbs"]
    key = spark.range(1).select(transcripts.cache_key(F.lit("large v3/é"), F.lit("")).alias("k")).first().k
    assert key == "transcript_v2_large_v3_é_auto.json"


def test_metadata_files(spark):
    reply = '{"youtube_title": "", "youtube_tags": [" a ", "", "b"], "tiktok_description": " short ", "tiktok_hashtags": "none", "mentions": ["@x"]}'
    d = models.metadata(_clips(spark, ["t", "u"]), models.Canned({"A title": reply}), wait=0.0)
    r = exports.metadata_text(d).first()
    assert r.file == "clip_01_A_title_with_a_comma_metadata.txt"
    lines = r.body.split("\n")
    assert lines[:3] == ["CLIP #1 — A title, with a comma", "00:10 -> 00:40  (30s)", "=" * 66] and "Title: A title, with a comma" in lines and "Tags: a, b" in lines and "short" in lines and "@x" in lines and "Hashtags: " in lines
    assert exports.metadata_text(d.withColumn("metadata", F.lit(None).cast("string"))).count() == 0


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT repaired_json('{\"a\": [1, 2,]') AS j").first().j is not None
    assert [r.item for r in spark.sql("SELECT * FROM reply_items('{\"c\": [{\"x\": 1}, {\"x\": 2}, {\"x', 'c')").collect()] == ['{"x": 1}', '{"x": 2}']


def test_run_stats_and_speech(spark):
    one = lambda n, kind="story": spark.createDataFrame([("t", kind) for _ in range(n)], "transcript_id string, clip_type string")
    r = insights.run_stats(one(9), one(2), one(7), one(5), one(3).union(one(1, "opinion")), 12).first()
    assert (r.sentences, r.blocks, r.candidates_pass1, r.candidates_after_merge, r.final, r.requested, r.types) == (9, 2, 7, 5, 4, 12, {"story": 3, "opinion": 1})
    s = spark.createDataFrame([("t", 0.0, 5.0, 20), ("t", 6.0, 8.0, 3), ("t", 8.0, 9.0, 3), ("t", 9.0, 10.0, 3)], "transcript_id string, start double, end double, n_words int")
    got = {x.transcript_id: (x.enough, x.speech_ratio) for x in segment.require_speech(s, spark.createDataFrame([("t", 18.0), ("silent", 5.0)], "transcript_id string, duration double")).collect()}
    assert got == {"t": (True, 0.5), "silent": (False, 0.0)}


def test_top_up():
    out = rank.top_up([clip(0, 10)], [clip(5, 12), clip(20, 30), clip(25, 40), clip(50, 60)], 3)
    assert [c["start"] for c in out] == [0, 20, 50]


def test_fit_and_trim():
    s = {"start": np.arange(10) * 10.0, "end": np.arange(10) * 10.0 + 10, "pause_before": np.zeros(10), "pause_after": np.zeros(10)}
    assert rank.fit_duration(s, 4, 4, 30, 60) == (4, 6) and rank.fit_duration(s, 0, 9, 20, 50) == (0, 4) and rank.fit_duration(s, 9, 9, 300, 400) is None
    assert rank.trim_edges(s, 2, 8, 30, [x >= 7 for x in range(10)], [x == 2 for x in range(10)]) == (3, 6)


def test_retention(spark):
    rows = [("g", "A", 90.0, 0.0, "t1"), ("g", "B", 80.0, 10.0, "t2"), ("g", "C", 70.0, 25.0, "t3"), ("g", "D", 60.0, 15.0, "t4"), ("g", "E", 50.0, 12.0, "t5"), ("h", "X", 1.0, 0.0, "t"), ("h", "Y", 2.0, 9.0, "t")]
    d = spark.createDataFrame(rows, "g string, k string, v double, p double, t string")
    got = {(r.g, r.position): r.k for r in rank.retention(d, "g", "v", "p", "t", "k").collect()}
    assert "".join(got["g", i] for i in range(1, 6)) == "ABEDC" and got["h", 1] == "Y"
    assert rank.spread_types(["a", "a", "b"]) == [0, 2, 1] and rank.spread_types(["a", "a"]) == [0, 1]


def test_gaps_golden(spark):
    d = spark.createDataFrame([("t", 3.0, 5.0), ("t", 5.5, 9.0), ("t", 12.0, 20.0), ("t", 11.8, 13.0)], "g string, s double, e double")
    got = sorted((r.gap_start, r.gap_end) for r in intervals.gaps(d, "g", "s", "e", 2.5, spark.createDataFrame([("t", 24.0)], "g string, duration double")).collect())
    assert got == [(0, 3), (9, 11.8), (20, 24)]


def test_interval_algebra_on_random_sets(spark):
    r = random.Random(3)
    rows = [(g, a, a + r.uniform(0, 9)) for g in "abc" for a in (r.uniform(0, 100) for _ in range(25))]
    frames = spark.createDataFrame([(g, -1.0, 120.0) for g in "abcd"], "g string, s double, e double")
    d = spark.createDataFrame(rows, "g string, s double, e double")
    left = intervals.subtract(frames, d, "g", "s", "e", 0.0).collect()
    covered = intervals.union(d, "g", "s", "e", 0.0).collect()
    for g in "abc":
        assert sum(x.e - x.s for x in left if x.g == g) + sum(x.e - x.s for x in covered if x.g == g) == pytest.approx(121.0)
    assert [(x.s, x.e) for x in left if x.g == "d"] == [(-1.0, 120.0)]
    pairs = intervals.pairs_by_bin(d.withColumn("k", F.monotonically_increasing_id()), "g", "s", "e", "k", 4.0)
    want = sum(1 for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert pairs.count() == want


def test_keep_spans_golden(spark):
    w = spark.createDataFrame([("c", 0.0, 0.5, "hi"), ("c", 0.6, 0.8, "um"), ("c", 2.0, 2.4, "there")], "clip_id string, start double, end double, text string")
    c = spark.createDataFrame([("c", 0.0, 4.0), ("silent", 1.0, 2.0)], "clip_id string, start double, end double")
    got = sorted((r.clip_id, round(r.start, 3), round(r.end, 3)) for r in trimming.keep_spans(w, c).collect())
    assert got == [("c", 0, 0.54), ("c", 1.825, 2.575), ("c", 3.825, 4.0), ("silent", 1.0, 2.0)]


@pytest.mark.parametrize("seed", range(3))
def test_captions(seed):
    a, b, w = transcript(seed, 20)
    ev = captions.events(list(zip(a.tolist(), b.tolist(), w)), 20)
    assert len(ev) == len(w) and all(e > s for _, _, s, e, _, _ in ev)
    cut = captions.phrase_starts(a.tolist(), b.tolist(), w)
    assert all(y - x <= 4 for x, y in zip(cut, cut[1:]))
    t = captions.timeline(a.tolist(), b.tolist())
    assert all(x < y for x, y in zip(t, t[1:]))
    text = captions.subtitle(list(zip(a.tolist(), b.tolist(), w)), 1080, 1920)
    assert text.count("Dialogue:") == len(w) and captions.ass_time(3661.239) == "1:01:01.24" and captions.clean("{Hi}!", captions.STYLE) == "(HI)"


def test_camera():
    r = random.Random(2)
    t = [k / 3 for k in range(300)]
    cx = [None if r.random() < 0.2 else min(1, max(0, 0.5 + 0.4 * np.sin(k / 9) + r.uniform(-0.05, 0.05))) for k in range(300)]
    segs = camera.path(t, cx, [k % 97 == 96 for k in range(300)], 100.0)
    assert 1 < len(segs) <= 80 and segs[0][0] == 0.0 and segs[-1][1] >= 100.0 and all(x[1] == pytest.approx(y[0]) for x, y in zip(segs, segs[1:]))
    assert camera.path([], [], [], 5.0) == [(0.0, 5.0, 0.5, 0.5)] and camera.path([0.0, 1.0, 2.0], [None, None, 0.3], [False] * 3, 2.0) == [(0.0, 2.5, 0.3, 0.3)]
    assert camera.crop_expression([(0.0, 5.0, 0.5, 0.5)], 1920, 608) == "656"
    assert camera.crop_expression([(0.0, 2.0, 0.2, 0.2), (2.0, 5.0, 0.2, 0.6)], 1920, 608) == "lt(t,2)*80+gte(t,2)*(80+(768)*(t-2)/3)"


def test_mark_cuts(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([0, 5, 6, 5, 90, 4, 5, 6])] + [("b", k, float(v)) for k, v in enumerate([0, 90, 1, 90, 1, 90, 1])]
    d = camera.mark_cuts(spark.createDataFrame(rows, "g string, t int, d double"), "g", "t", "d")
    assert [(r.g, r.t) for r in d.where("cut").collect()] == [("a", 4)]


def test_insights(spark):
    rows = [(g, float(v), float(10 * v + n)) for n, g in enumerate(["v1", "v2", None]) for v in (1, 2, 3, 4)] + [("single", 1.0, 5.0), ("flat", 1.0, 7.0), ("flat", 2.0, 7.0)]
    d = spark.createDataFrame(rows, "g string, x double, e double")
    z = insights.zscores(d, "g", "e")
    assert z.count() == 12 and z.agg(insights.pearson("x", "z").alias("c")).first().c == pytest.approx(1.0)
    assert d.where("g = 'flat'").agg(insights.pearson("x", "e").alias("c")).first().c == 0.0
    w = spark.createDataFrame([("hook", 25.0), ("payoff", 25.0), ("emotion", 15.0), ("curiosity", 15.0), ("standalone", 10.0), ("editability", 10.0)], "measure string, weight double")
    c = spark.createDataFrame([("hook", 0.5), ("payoff", -0.4), ("emotion", 0.29)], "measure string, correlation double")
    got = {r.measure: r.weight for r in insights.suggest(c, w).collect()}
    assert got == pytest.approx({"hook": 31.25, "payoff": 18.75, "emotion": 15, "curiosity": 15, "standalone": 10, "editability": 10})


def test_performance_log(spark):
    clips = spark.createDataFrame([("v", 1, "story", 80.0)], "video_hash string, rank int, clip_type string, overall double")
    entries = spark.createDataFrame([("v", 1, None, 100), ("v", 2, "funny", 5)], "video_hash string, rank int, clip_type string, views int")
    got = {r["rank"]: (r.clip_type, r.overall, r.views) for r in insights.log(clips, entries).collect()}
    assert got == {1: ("story", 80.0, 100), 2: ("funny", None, 5)}


def test_sources(spark, tmp_path):
    segs = spark.createDataFrame([("t", "en", 1, 2.0, 4.0, "c d", None), ("t", "en", 0, 0.0, 2.0, "x", [(0.0, 0.5, " a ", None), (0.5, 1.0, "", 0.3), (1.0, 2.0, "b", 0.9)])], "transcript_id string, language string, seg_idx int, start double, end double, text string, words array<struct<start:double,end:double,text:string,prob:double>>")
    w = transcripts.flatten(segs).first()
    assert [(x.start, x.end, x.text) for x in w.words] == [(0, 0.5, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")]
    (tmp_path / "h1").mkdir()
    (tmp_path / "h2").mkdir()
    (tmp_path / "h1" / "transcript.json").write_text('{"language":"en","duration":2,"raw_segments":[{"start":0,"end":1,"text":"hi"}]}')
    (tmp_path / "h2" / "transcript.json").write_text('{"language":"en","raw_segments":[]}')
    assert [r.transcript_id for r in transcripts.read_cached(spark, str(tmp_path / "*" / "*.json")).collect()] == ["h1"]
    assert [r.name for r in media.cache_entries(spark, str(tmp_path)).collect()] == ["h1", "h2"]
    assert len(media.fingerprints(spark, str(tmp_path)).first().fingerprint) == 20
    probe = '{"format":{"filename":"/a/b.mp4","duration":"10.5","size":"99"},"streams":[{"codec_type":"video","codec_name":"png","disposition":{"attached_pic":1}},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"0/0","r_frame_rate":"30000/1001","duration":"11"},{"codec_type":"audio","codec_name":"aac"}]}'
    m = media.parse_probe(spark.createDataFrame([(probe,)], "probe string")).first()
    assert (m.duration, m.width, m.vcodec, m.acodec, m.has_audio, m.filename, round(m.fps, 2)) == (11.0, 1920, "h264", "aac", True, "b.mp4", 29.97)


def test_models(spark):
    b = models.Canned({"apple": '{"candidates":[{"start_index":0,"end_index":3,"hook":"20/25","clip_type":"joke"}]}'})
    d = spark.createDataFrame([(1, "an apple"), (2, "a pear")], "i int, prompt string")
    got = {r.i: r.reply for r in models.replies(d, b, "s", wait=0.0).collect()}
    assert got[2] is None and "candidates" in got[1]
    sc = _scorer(1)
    out = models.read_block_reply(got[1], sc, 0, 10, 5, 90)
    assert len(out) == 1 and out[0]["scores"]["hook"] == 25.0 and out[0]["clip_type"] == "funny"
    moved = models.move_bounds(out[0], '{"start_index": 1, "end_index": 5, "title": "Better title"}', sc, 5, 90)
    assert moved["boundary_optimized"] and moved["title"] == "Better title" and moved["start_idx"] >= 1
    assert models.per_block(12, 2) == 12 and models.per_block(12, 9) == 5


def test_plans_and_exports(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12)
    t = transcripts.from_documents(docs)
    c = analyze.clips(t).cache()
    n = c.count()
    assert n > 0 and c.where("end <= start or overall > 100").count() == 0
    text = c.withColumns({"text": F.lit("x  y"), "reason": F.lit("a\n b")})
    exports.write_reports(text, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).count() == n
    exports.write_cache(t, str(tmp_path / "cache"))
    exports.write_cache(t.limit(3), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == t.where(F.size("words") > 0).count()
    p = exports.plan_clips(c, t.select("transcript_id", "duration"), ("16:9", "9:16", "9:16", "bad"))
    assert p.count() == 2 * n and p.where("stream_copy and format != '16:9'").count() == 0
    assert exports.video_filter((1920, 1080), "9:16") == "crop=608:1080:x=(iw-608)/2:y=0,scale=1080:1920,setsar=1"
    assert "[vout]" in exports.video_filter((1920, 1080), "1:1", watermark={"scale": 0.2}) and exports.music_graph(10, 1).endswith("[aout]")
    c.unpersist()


def test_config():
    c = config.load({"clips": {"min_duration": "30", "lambda": 7}, "weights": {"hook": 40, "bogus": 3}})
    assert c["clips"]["min_duration"] == 30 and c["clips"]["lambda"] == 1.0 and "bogus" not in c["weights"] and c["weights"]["payoff"] == 25


def test_sections_of_options(tmp_path):
    logo = tmp_path / "logo.png"
    logo.write_bytes(b"x")
    c = config.load({"watermark": {"enabled": True, "path": f" {logo} ", "opacity": 9, "scale": "wide", "position": "up"}, "music": {"enabled": True, "path": "/nowhere"}, "tightening": {"enabled": 1, "min_gap": "0.3", "keep_pause": 0.9}, "reframe": {"formats": ["1:1", "7:3", "1:1 ", "16:9"], "layout": "zoom"}, "weights": {"hook": "much"}})
    assert config.usable(c, "watermark") == {"path": str(logo), "opacity": 1.0, "scale": 0.18, "margin": 0.04, "position": "top_right"}
    assert config.usable(c, "music") is None and config.usable(c, "music", lambda p: p == "/nowhere") == {"path": "/nowhere", "volume": 0.15, "fade_seconds": 0.6}
    assert config.usable(c, "tightening") == {"remove_fillers": True, "min_gap": 0.3, "keep_pause": pytest.approx(0.2)} and config.usable(c, "thumbnail") is None
    assert c["reframe"] == {"formats": ["1:1", "16:9"], "layout": "crop"} and c["weights"]["hook"] == 25.0
    assert config.load({"reframe": {"formats": "4:5"}})["reframe"]["formats"] == ["4:5"] and config.load({"reframe": {"formats": []}})["reframe"]["formats"] == ["9:16"]
    assert config.load()["watermark"] == config.DEFAULTS["watermark"]


def test_options_reach_the_plan(spark):
    t = transcripts.from_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(6))
    found, plan = analyze.configured(t, {"clips": {"target_count": 2, "min_duration": 15}, "weights": {"hook": 70, "payoff": 0}, "reframe": {"formats": ["1:1", "16:9"]}})
    rows = found.collect()
    assert rows and max(r["rank"] for r in rows) == 2 and {r.format for r in plan.collect()} == {"1:1", "16:9"}
    w = scoring.CATEGORY_MAX | {"hook": 70.0, "payoff": 0.0}
    alone = [r for r in rows if r.merged_from == 1]  # a merged clip has the better of each score
    assert alone and all(r.overall == pytest.approx(rank.overall({k: r[k] for k in w}, w)) for r in alone)
    assert any(abs(r.overall - rank.overall({k: r[k] for k in w}, scoring.CATEGORY_MAX)) > 1 for r in rows)


def test_named_exports_stay_and_caches_part_by_model(spark, tmp_path):
    c = _clips(spark, ["t0", "t1"])
    names = spark.createDataFrame([("t0", "/in/My talk #1.final.mp4"), ("t0", "/in/other.mp4")], "transcript_id string, filename string")
    for hour in (10, 11, 11):
        exports.write_reports(c, str(tmp_path / "out"), names, F.lit(f"2024-05-01 {hour}:00:00").cast("timestamp"))
    got = sorted(str(p.relative_to(tmp_path / "out" / "txt")) for p in (tmp_path / "out" / "txt").glob("*/*"))
    assert got == sorted(f"transcript_id={t}/export={n}_20240501_{h}0000" for t, n in (("t0", "My_talk_1.final"), ("t1", "clips")) for h in (10, 11))
    assert spark.read.text(str(tmp_path / "out" / "json")).count() == 4
    t = transcripts.from_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(2))
    for model in ("large v3/é", "small"):
        exports.write_cache(t, str(tmp_path / "cache"), model)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["transcript_v2_large_v3_é_auto", "transcript_v2_small_auto"]


def test_status_of_a_model_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/api/tags": b'{"models": [{"name": "small:7b"}, {"name": "other:1b"}]}', "/v1/models": b'{"data": []}'}.get(self.path, b"no json")
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        got = models.ChatServer("ollama", url, "small").status()
        assert got["ok"] and got["installed"] and got["models"] == ["small:7b", "other:1b"] and not got["error"]
        got = models.ChatServer("ollama", url, "large").status()
        assert got["ok"] and not got["installed"] and "large" in got["error"]
        assert models.ChatServer("openai", url, "any").status()["installed"]
        assert not models.ChatServer("openai", url + "/elsewhere", "any").status()["ok"]
    finally:
        server.shutdown()
    assert not models.ChatServer("ollama", url, "small").status(timeout=0.5)["ok"]


def test_nearest_both_ways_and_ties(spark):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "a", 99.0), (4, "b", 10.0), (5, None, 1.0), (6, "a", None), (7, "a", -0.5)], "id int, k string, t double")
    right = spark.createDataFrame([(11, "a", 8.0), (12, "a", 12.0), (13, "a", 12.0), (14, "a", 22.0), (15, "a", 22.0), (16, "b", 15.1), (17, None, 1.0), (18, "a", 4.5)], "id int, k string, t double")
    got = {r.id: (r.near_row, r.apart) for r in intervals.nearest(left, right, "k", "t", "id", 5.0).collect()}
    assert got == {1: (11, 2.0), 2: (14, 2.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (18, 5.0)}
    assert intervals.nearest(left.limit(0), right, "k", "t", "id", 5.0).count() == 0


def test_fewer_pieces_drop_the_least_move_first():
    rng = random.Random(5)
    for n in (1, 2, 5, 30, 90):
        for _ in range(20):
            segs = [(float(i), i + 1.0, rng.randint(0, 6) / 8, rng.randint(0, 6) / 8) for i in range(n)]
            for most in (1, 3, 29, 80):
                want = list(segs)
                while len(want) > most:
                    move = [abs(b[3] - b[2]) + abs(b[2] - a[3]) for a, b in zip(want, want[1:])]
                    k = move.index(min(move))
                    want[k : k + 2] = [(want[k][0], want[k + 1][1], want[k][2], want[k + 1][3])]
                assert camera.fewer(segs, most) == want


def test_camera_path_sql_beyond_most_pieces(spark, tmp_path):
    """One user with so many moves that pieces are joined, another who is rarely seen, a third with one event."""
    n = F.col("id")
    e = spark.range(900).select(
        n.alias("event_id"), F.when(n < 800, 1).when(n < 899, 2).otherwise(3).cast("long").alias("user_id"), F.when((n >= 800) & (n % 4 > 0), "signup").otherwise("click").alias("event_type"),
        (F.timestamp_seconds(1700000000 + n * 40000)).cast("timestamp_ntz").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 5.0).alias("value"),
    )
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["camera_path"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(queries.SQL["camera_path"]).fetchall()
    flat = lambda rows: sorted((r[0], r[1], *(round(x, 9) for x in r[2:])) for r in rows)
    assert sum(r.transcript_id == "1" for r in got) == camera.MOST and {r.transcript_id for r in got} == {"1", "2", "3"}
    assert flat(map(tuple, got)) == flat(want)


def test_upper_median_of_large_groups_with_outliers(spark):
    """A group past the size where percentiles bound it, with one far value and heavy ties; small ones, null groups and values."""
    n = F.col("id")
    d = spark.range(90_000).select(
        F.when(n < 50_000, "a").when(n < 80_000, "b").when(n < 80_003, "c").when(n < 80_004, "d").when(n < 80_005, "n").alias("g"),
        F.when(n == 7, 1e300).when(n < 50_000, F.pmod(F.xxhash64("id"), F.lit(40_000)) / 7.0).when(n < 80_000, F.pmod(F.xxhash64("id"), F.lit(3)).cast("double")).when(n < 80_004, n - 80_000.0).when(n > 80_004, -n.cast("double")).alias("v"),
    )
    want = {}
    for g, v in d.where("v is not null").collect():
        want.setdefault(g, []).append(v)
    got = {r.g: r.median for r in insights.upper_median(d, "g", "v").collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got == {g: sorted(v)[len(v) // 2] for g, v in want.items()}


def test_many_small_groups_are_one_pass(spark):
    """dedupe, mmr and retention over thousands of pools call Python for batches, and give each pool what it has alone."""
    r = random.Random(5)
    rows = [(None if g == 7 else f"g{g}", k, i := r.randrange(50), i + 4, i * 5.0, (i + 5) * 5.0, float(r.randrange(40)), float(k), 0.5, r.choice("ab"), "heuristic", 1, float(r.randrange(25))) for g in range(6000) for k in range(1 + g % 5)]
    names = "g string, pos long, start_idx int, end_idx int, start double, end double, overall double, heuristic double, confidence double, clip_type string, source string, merged_from int, hook double"
    d = spark.createDataFrame(rows, names).repartition(7)
    cols, pools = [c.split()[0] for c in names.split(", ")], {}
    for x in rows:
        pools.setdefault(x[0], []).append({**dict(zip(cols, x)), "duration": 400.0, "scores": {"hook": x[-1]}})
    one = rank.dedupe_rows(d, "g")
    want = [{**c, **c["scores"]} for p in pools.values() for c in rank.dedupe(p, {c["start_idx"]: c["start"] for c in p}, {c["end_idx"]: c["end"] for c in p})]
    assert sorted(map(str, one.collect())) == sorted(str(Row(**{c: x[c] for c in cols})) for x in want)
    two = rank.mmr_rows(d.withColumn("duration", F.lit(400.0)), "g", 3)
    want = [{**c, "g": g} for g, p in pools.items() for c in rank.select(p, 3, 400.0)]
    assert sorted((str(x.g), x.pos, x["rank"]) for x in two.collect()) == sorted((str(c["g"]), c["pos"], c["rank"]) for c in want)
    three = rank.retention(d, "g", "overall", "hook", "clip_type", "pos")
    for x in (one, two, three):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "MapInArrow" in plan
    got = {}
    for x in three.collect():
        got.setdefault(x.g, []).append(x.position)
    assert {g: sorted(x) for g, x in got.items()} == {g: list(range(1, len(p) + 1)) for g, p in pools.items()}


def test_caption_events_come_in_bounded_batches():
    n, words = 300, [f"w{k}" for k in range(400)]
    start = [k * 0.4 for k in range(400)]
    batch = pa.RecordBatch.from_pydict({"id": [str(k) for k in range(n)], "s": [start] * n, "e": [[x + 0.4 for x in start]] * n, "w": [words] * n})
    kinds = [("transcript_id", pa.string()), ("phrase", pa.int32()), ("word", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())]
    got = list(captions.event_batches([batch], captions.STYLE, pa.schema(kinds)))
    assert max(b.num_rows for b in got) <= captions.EVENTS and sum(b.num_rows for b in got) == n * len(words)
