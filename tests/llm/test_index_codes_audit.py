"""Suffix-array dedup, vector codes and source divergence against plain loops, with their edge rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import divergence, suffix_dedup, vector_codes
from tests.llm.test_edges import CLASH, LONG, ROWS, SCHEMA

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


# ---- suffix-array dedup ----------------------------------------------------


def repeats(rows, k):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + k] for b in data for i in range(len(b) - k + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if seen[b[j : j + k]] > 1:
                gone[j : j + k] = b"\1" * k
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s], kept))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = lambda n, of: "".join(r.choice(of) for _ in range(n))
    shared = [some(r.randint(5, 90), "abé") for _ in range(6)]
    rows = [(i, "".join(r.choice(shared) if r.random() < 0.3 else some(r.randint(0, 30), "abcdefé ") for _ in range(r.randint(0, 8)))) for i in range(90)]
    rows += [(200, "aaaa" * 50), (201, "abab" * 30), (202, None), (203, ""), (204, rows[3][1]), (204, rows[3][1]), (None, rows[5][1]), (None, None)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("length", [2, 7, 20, 75])
def test_suffix_dedup(spark, texts, length, hot):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, list(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length, hot=hot).collect()], key=str)
    assert got == repeats(texts, length)


@pytest.mark.parametrize("batch", [1, 3, 8, 10_000])
def test_family_of_any_batch_size(texts, monkeypatch, batch):
    """However the entries are dealt into batches, levels merge to the same answer; slices of a text do not show either."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    for k in (6, 40):
        x = suffix_dedup.Anchors([(t or "").encode() for _, t in texts], k)
        raw = x.buf.tobytes()
        u, where, n = np.unique(x.fp, return_index=True, return_counts=True)
        head = np.zeros(len(u), suffix_dedup._HEAD)
        head["fp"], head["gram"], head["left"], head["least"], head["many"] = u, x.gram[where], (x.at - x.first)[where], (x.at - x.last)[where], n > 1
        head["size"] = (x.last - x.first)[where] + k
        found = {int(c["fp"]): c for c in suffix_dedup.matches(head, [b"".join(raw[a:b] for a, b in zip(x.first[where], x.last[where] + k))], k, batch)}
        gone = np.zeros(len(raw), bool)
        for at, fp in zip(x.at.tolist(), x.fp.tolist()):
            if fp in found:
                gone[at - int(found[fp]["most"]) : at - int(found[fp]["least"]) + k] = True
        assert gone.sum() == sum(r[2] for r in repeats(texts, k))


def test_levels_double():
    f = suffix_dedup.Family(4, np.zeros(64, int), np.zeros(64, int), np.zeros(64, bool))
    for i in range(13):
        f.add([(b"%04d" % i, b"", i)])
        assert [bool(x) for x in f.levels] == [b == "1" for b in reversed(bin(i + 1)[2:])]
    assert [len(x) for x in f.levels if x] == [1, 4, 8]


def test_passage_of_very_many_contexts(spark):
    """A gram with more distinct entries than one bucket takes goes by its windows: the passage goes from each document, its own bytes stay."""
    r = random.Random(8)
    own = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(230))
    passage = own()
    rows = [(i, own() + passage + own()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (10, 20_000):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, list(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 200, hot=hot).collect()]
        assert sorted(got, key=str) == repeats(rows, 200) and all(230 <= r[2] < 240 for r in got)


def test_suffix_dedup_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = {str(r.doc_id) + str(r.n_bytes): (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs, 20).collect()}
    want = {str(i) + str(n): (n, gone) for i, n, gone, *_ in repeats([(r[0], r[1]) for r in ROWS], 20)}
    assert got == want and got[f"4{len(LONG)}"][1] >= 0
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, LONG), (2, LONG), (3, "x" + LONG[:-1])], "doc_id long, text string")
    assert {(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(twice).collect()} == {(len(LONG), len(LONG)), (len(LONG), len(LONG) - 1)}


# ---- vector codes ------------------------------------------------------------


def lloyd(rows):
    keep = sorted([(i, [math.floor(1024 * float(np.float32(x))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in keep) // 4)
    data = np.array([v + [0] * (4 * width - len(v)) for _, v, _ in keep], np.int64).reshape(-1, 4, width)
    books = data[:256].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((data[:, p][:, None] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(4)])
    for _ in range(4):
        a = nearest()
        for p in range(4):
            for e in range(books.shape[1]):
                of = data[a[p] == e, p]
                if len(of):
                    books[p, e] = of.sum(0) // len(of)
    a = nearest()
    error = sum(((data[:, p] - books[p][a[p]]) ** 2).sum(-1) for p in range(4))
    total = Counter()
    for (_, _, la), e in zip(keep, error):
        total[la] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted([(i, "".join(f"{a[p][j]:02x}" for p in range(4)), int(error[j]), total[la], sha) for j, (i, _, la) in enumerate(keep)], key=str)


@pytest.mark.parametrize("n", [1, 40, 700])
def test_vector_codes(spark, monkeypatch, n):
    r = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=10) * 0.2], int(i % 5) if i % 7 else None) for i in r.permutation(n)]
    rows += [(9001, None, 1), (9002, [None] * 10, 1), (9003, [float("nan")] * 10, 1), (9004, [0.1] * 9 + [float("-inf")], 2), (5000, rows[0][1], None), (5000, rows[0][1], None), (None, rows[0][1], 3), (5001, rows[0][1][:3], 1), (5002, [], 1)]
    df = spark.createDataFrame([(*x, "mine", "mine") for x in rows], "vec_id long, embedding array<float>, label int, code string, error string").repartition(3)
    assert sorted(map(tuple, vector_codes.compress(df).collect()), key=str) == lloyd(rows)
    assert vector_codes.compress(df.limit(0)).count() == 0
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)
    if n == 40:
        assert sorted(map(tuple, vector_codes.compress(df).collect()), key=str) == lloyd(rows)


def test_heaps_measure_less_and_miss_nothing():
    """With books that hardly move, only what the drift may have changed is popped; the entries are those of a full measure."""
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (3000, 8))
    book = r.integers(-300, 300, (64, 8))
    k = vector_codes.ENTRIES
    entry = np.zeros(len(x), np.uint8)
    heaps = vector_codes.Heaps(np.bincount(np.zeros(len(x), int), minlength=k), np.full(len(x), -np.inf), np.arange(len(x), dtype=np.int32))
    drift = np.zeros(k)
    _, _, heaps = vector_codes.reassign(x, entry, heaps, book, drift)
    for step in range(6):
        old, book = book, book + r.integers(-2, 3, book.shape)
        move = np.sqrt(((book - old) ** 2).sum(axis=1)) * (1 + 1e-12)
        drift[:64] += move + move.max()
        rows, _, heaps = vector_codes.reassign(x, entry, heaps, book, drift)
        assert len(rows) < len(x) / 2 and heaps.size.sum() == len(x)
        assert (entry == vector_codes.measure(x, book)[0]).all()


# ---- source divergence --------------------------------------------------------


def audited(rows, least, top=10):
    occurs, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, la, s in rows:
        t, la, s = t or "", la or "", s or ""
        groups[la].add(s)
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in TERM.findall(t)]
        occurs[la, s].update(words)
        docs[la].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for la, sources in groups.items():
        kept = [w for w, n in docs[la].items() if n >= least]
        share = lambda c, n, v=len(kept): 1 + 10**9 * (c + 2) // (n + 2 * v)
        size = {s: sum(occurs[la, s][w] for w in kept) for s in sources}
        whole = {w: sum(occurs[la, s][w] for s in sources) for w in kept}
        for s in sources:
            p = {w: share(occurs[la, s][w], size[s]) for w in kept}
            pairs = sorted((-sum(f(p[w], share(occurs[la, o][w], size[o])) for w in kept), o.encode(), o) for o in sources if o != s)
            q = {w: share(whole[w], sum(size.values())) for w in kept}
            best = sorted((-f(p[w], q[w]), w.encode(), w) for w in kept if occurs[la, s][w] and p[w] > q[w])[:top]
            out += [(la, s, part, x, -v, i) for part, found in (("pair", pairs), ("term", best)) for i, (v, _, x) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [60, 250_000])
def test_audit(spark, monkeypatch, most):
    monkeypatch.setattr(divergence, "RANGE", most)
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdeéñ中") for _ in range(r.randint(1, 4))) for _ in range(150)]
    rows = [(" ".join(r.choice(vocabulary[: r.randint(5, 150)]).title() if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.randint(0, 40))) + "12_x" if r.random() < 0.95 else None, r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", "é", None, "z"])) for _ in range(400)]
    rows += [("solo words", "xx", "only"), (None, "yy", "p"), ("", "yy", "q"), *[("tie other tie", "tt", "s")] * 3, *[("other", "tt", "t")] * 3]
    df = spark.createDataFrame([(*x, 1, "mine") for x in rows], "text string, lang string, source string, kept int, value string").repartition(5)
    for least in (10, 1):
        assert sorted(map(tuple, divergence.audit(df, least).collect()), key=str) == audited(rows, least)


def test_audit_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, 2).collect()), key=str) == audited([r[1:4] for r in ROWS], 2)
    assert divergence.audit(docs.limit(0)).count() == 0 and len(CLASH) > 20


def test_tries_merge_and_read_back():
    r = random.Random(4)
    tries, want = [], Counter()
    docs = Counter()
    for _ in range(5):
        texts = [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(40)).encode() for _ in range(6)]
        sources = [r.choice("xyz") for _ in texts]
        for t, s in zip(texts, sources):
            words = t.decode().split()
            want.update((w.encode(), s) for w in words)
            docs.update({w.encode() for w in words})
        tries.append(divergence.block_tries(["en"] * 6, sources, texts)["en"])
    whole = divergence.Trie.merged(tries)
    for depth in (1, 2, 5):
        back = [divergence.Trie.read(row) for row in whole.rows("en", depth).to_pylist()]
        terms = [t for b in back for t in b.terms.to_pylist()]
        assert terms == sorted(terms) == whole.terms.to_pylist()
        got, n = Counter(), Counter()
        for b in back:
            at = np.repeat(np.arange(len(b.terms)), b.counters)
            for k, s, c in zip(at.tolist(), b.source.tolist(), b.counts.tolist()):
                if b.terms[k].as_py():
                    got[b.terms[k].as_py(), b.names[s]] += c
            n.update(dict(zip(b.terms.to_pylist(), b.docs.tolist())))
        assert got == want and {k: v for k, v in n.items() if k} == docs


def test_share_does_not_overflow():
    for count, n, kept in ((0, 0, 1), (10**12, 10**14, 10**9), (7 * 10**13, 10**14, 3), (5, 9, 2)):
        assert int(divergence.share(np.array([count]), n, kept)[0]) == 1 + 10**9 * (count + 2) // (n + 2 * kept)


def test_long_text_counts_whole(spark):
    df = spark.createDataFrame([(LONG, "en", "a"), (LONG.upper(), "en", "b"), (None, "en", None)], "text string, lang string, source string").withColumn("doc_id", F.lit(1))
    assert sorted(map(tuple, divergence.audit(df, 2).collect()), key=str) == audited([(LONG, "en", "a"), (LONG.upper(), "en", "b"), (None, "en", None)], 2)
