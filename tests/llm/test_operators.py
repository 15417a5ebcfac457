"""The training-data operators against brute-force versions, round trips and edge rows."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import decontam, kern, langid, mixing, pii, quality, simhash, substring_dedup, toxicity, url_filter, warc
from tests.llm import brute, reparam

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, words int, kept string"


def vocabulary(seed, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = vocabulary(1)
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts += [texts[0], texts[1], f"{texts[2]}\n{passage} end", f"{passage}\t{texts[3]}", "a b " * 60, "", None, " \n\t ", "één Straße naïve " + passage[:80], "word " * 3000]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t else None, "x", 1, "y") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "no id here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(v):
    return tuple("" if x is None else str(x) for x in v)


def test_words_match_the_pattern():
    texts = ["a  b\tc\x0b", "", "é\x0cß \x85x", None, "one"]
    w = kern.Words([t.encode() if t else None for t in texts])
    assert w.count.tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_pack_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (kern.unpack(kern.pack(x)) == x).all() and len(kern.unpack(b"")) == 0


def test_substring_dedup(docs, rows, empty):
    k = 8
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    want = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        want.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, k).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.remove_repeats(empty, k).count() == 0


def test_quality(docs, rows, empty):
    got = quality.judge(docs, digest=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for r in rows:
        if r[0] is None:
            continue
        t = r[1] or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = by[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep))
        assert g.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
        assert not (g.base_failed and g.kept)
    assert quality.judge(empty).count() == 0


def test_cascade_order_does_not_change_verdicts(rows):
    texts = [r[1].encode() if r[1] is not None else None for r in rows]
    a, _ = quality.cascade(texts, list(quality.RULES))
    b, _ = quality.cascade(texts, list(quality.RULES)[::-1])
    assert (a == b).all()
    figures = [("few_words", 1.0, 1, 9), ("symbols", 0.1, 5, 9)]
    assert quality.ordered(quality.RULES, figures)[0].name == "symbols"


def fingerprint(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs, 3, 2).select("doc_id", F.lower(F.hex("fp")).alias("fp"), "component_id").collect()
    assert len(got) == len(rows)
    fps = [fingerprint(r[1], 3) for r in rows]
    assert Counter(g.fp for g in got) == Counter(f"{x:016x}" for x in fps)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], least.get(find(i))) for i, r in enumerate(rows)), key=key)
    assert sorted(((g.doc_id, g.component_id) for g in got), key=key) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_equal_brute_force():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    a, b = fp[:200].reshape(-1, 1), fp[200:].reshape(-1, 1)
    forest = simhash._Forest(len(fp))
    for i, j in simhash.links(a, b, 2):
        forest.join(np.array([i]), np.array([j]))
    brute = simhash._Forest(len(fp))
    for i in range(200):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2):
            brute.join(np.array([i]), np.array([j]))
    assert (forest.label == brute.label).all()


def test_neighbours_are_all_count_vectors_within_the_radius():
    n = simhash._neighbours(4, 2)
    assert len(n) == 21 and all(abs(v).sum() <= 2 for v in n)


def test_components_of_a_long_path(spark):
    n = 70
    e = spark.createDataFrame([(bytes([0, i]), bytes([0, i + 1])) for i in range(n)] + [(b"\x01\x05", b"\x01\x02")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in simhash.components(e).collect()}
    assert len(got) == n + 3 and all(got[bytes([0, i])] == b"\x00\x00" for i in range(n + 1)) and got[b"\x01\x05"] == b"\x01\x02"


def test_components_of_links_that_differ_each_time_they_are_made(spark):
    """A tile's forest depends on the order its rows come in; it must be made once."""

    def forest(batches):
        import os

        import pyarrow as pa

        for _ in batches:
            r = random.Random(os.urandom(8))
            order = r.sample(range(60), 60)
            pairs = [(order[i], order[r.randrange(i)]) for i in range(1, 60)]
            yield pa.RecordBatch.from_arrays([pa.array([bytes([x]) for x in c], pa.binary()) for c in zip(*pairs)], names=["a", "b"])

    for _ in range(3):
        got = simhash.components(spark.range(1, numPartitions=1).mapInArrow(forest, "a binary, b binary")).collect()
        assert len(got) == 60 and {bytes(x.root) for x in got} == {b"\0"}


def test_keep_one_drops_near_copies_only(spark):
    r = random.Random(9)
    vocab = vocabulary(2, 2000)
    base = [[r.choice(vocab) for _ in range(200)] for _ in range(30)]
    texts = [" ".join(w) for w in base]
    copies = []
    for w in base[:10]:
        w = list(w)
        w[50], w[120] = "changed", "altered"
        copies.append(" ".join(w))
    half = [" ".join(base[20][:100] + base[21][:100])]
    d = spark.createDataFrame(list(enumerate(texts + copies + half + [texts[5]])), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one(d).collect()}
    assert kept == set(range(30)) | {40}


def test_keep_one_decides_by_exact_jaccard(spark):
    """Pairs on either side of 0.8: the 256-bit estimate alone gets many of them wrong."""
    r = random.Random(4)
    texts = []
    for k in range(80):
        a = [f"w{k}x{i}" for i in range(204)]
        b, at = list(a), r.randrange(0, 3)
        # every changed word takes five shingles: 4 leave 180 of 220 (0.82), 5 leave 175 of 225 (0.78)
        for c in range(4 + k % 2):
            b[at + 20 + 30 * c] = f"other{k}x{c}"
        texts += [" ".join(a), " ".join(b)]
    short = ["a b c d e f g h i", "a b c d e f g h", "q r s t u v w x y", "q r s t u v w z"]  # 4 of 5; 3 of 6
    d = spark.createDataFrame(list(enumerate(texts + short)), "doc_id long, text string")

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {i for i in range(0, 164, 2)} | {i + 1 for i in range(0, 164, 2) if len((x := shingles((texts + short)[i])) & (y := shingles((texts + short)[i + 1]))) / len(x | y) < 0.8}
    old, simhash.SETS = simhash.SETS, 512
    try:
        assert {x.doc_id for x in simhash.keep_one(d).collect()} == want
        # one large component of near copies is cut into blocks
        chain = [(i, " ".join(f"s{j}" for j in range(6 * i, 6 * i + 104))) for i in range(40)]
        simhash.SETS = 5
        assert [x.doc_id for x in simhash.keep_one(spark.createDataFrame(chain, "doc_id long, text string")).collect()] == [0]
    finally:
        simhash.SETS = old


def _allotted(sizes, weights, total, cap):
    """Share by weight, stop what is above, share the excess again, until none is above."""
    left, free, out = float(total), {k for k in sizes if sizes[k] > 0}, {k: 0.0 for k in sizes}
    while free:
        w = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / w > cap * sizes[k]]
        if not over:
            return out | {k: left * weights[k] / w for k in free}
        out |= {k: cap * sizes[k] for k in over}
        left -= sum(out[k] for k in over)
        free -= set(over)
    return out


def test_allot(spark):
    r = random.Random(3)
    cases = [[100, 100, 1000], [0, 10], [0], [1, 1, 1, 10**6], [r.randint(0, 10 ** r.randint(1, 7)) for _ in range(30)], [r.randint(0, 50) for _ in range(9)]]
    for sizes in cases:
        names = [f"s{i:02d}" if i else None for i in range(len(sizes))]
        order = sorted(range(len(sizes)), key=lambda i: (names[i] is None, names[i] or ""))
        weights = {i: (5, 2, 1)[k % 3] for k, i in enumerate(order)}
        want = _allotted(dict(enumerate(sizes)), weights, sum(sizes), 3.0)
        got = {x.source: x.target for x in mixing.allot(spark.createDataFrame(list(zip(names, sizes)), "source string, size long")).collect()}
        assert all(abs(got[names[i]] - want[i]) < 1e-6 * max(1, want[i]) for i in want)


def _mixed(rows, weights=(5, 2, 1), cap=3.0):
    """taken of rows (id, source, size, weight) by one sort for each source."""
    sizes = {}
    for _, s, z, _ in rows:
        sizes[s] = sizes.get(s, 0) + z
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = _allotted(sizes, {s: weights[k % 3] for k, s in enumerate(order)}, sum(sizes.values()), cap)
    out = {}
    for s in sizes:
        mine = [(-math.log((int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / (w if w and w > 1e-6 else 1e-6), i, z) for i, t, z, w in rows if t == s]
        epochs = int(target[s] / sizes[s]) if sizes[s] else 0
        rest = math.floor(target[s] - epochs * sizes[s] + 1e-6)
        for _, i, z in sorted(mine):
            out[i] = epochs * z + min(z, max(0, rest), math.floor(cap * z) - epochs * z)
            rest -= z
    return out


def test_mixing_against_one_sort(spark):
    """Hot source, tiny, null, NaN and zero weights, many range buckets, clashing names."""
    r = random.Random(14)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", "c", None, "d"]), r.choice([0, 1, 5, 40, 3000]), r.choice([1.0, 2.0, 0.5, 0.0, -3.0, 1e-9, None])) for i in range(4000)]
    d = spark.createDataFrame([(*x, "mine", 1, 2, 3) for x in rows], "doc_id long, source string, n long, q double, _key string, part int, `a.b` int, u int").repartition(5)
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 50
    try:
        m = mixing.mix(d, F.col("n"), F.col("q"))
        got = m.collect()
    finally:
        mixing.BUCKET_ROWS = old
    assert m.columns == [*d.columns, "size", "source_size", "target", "taken"] and {(x._key, x.part, x["a.b"], x.u) for x in got} == {("mine", 1, 2, 3)}
    assert {x.doc_id: x.taken for x in got} == _mixed(rows)
    none = spark.createDataFrame([(None, None, 7), (None, None, 9), (None, "a", None)], "doc_id long, source string, n long")
    assert sorted(x.taken for x in mixing.mix(none, F.col("n")).collect()) == [0, 7, 9]


def test_mixing(docs, rows, empty, spark):
    m = mixing.mix(docs, mixing.n_words(F.col("text")))
    got = m.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, m.collect()))
    by = {}
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    for s, g in by.items():
        assert sum(r["size"] for r in g) == g[0].source_size
        biggest = max(r["size"] for r in g)
        assert -biggest <= sum(r.taken for r in g) - g[0].target <= 1e-6
    assert mixing.mix(empty, mixing.n_words(F.col("text"))).count() == 0


def test_mixing_many_buckets(spark):
    d = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 50 + 1).alias("n")).union(spark.range(100).select(F.col("id") + 10000, F.lit("b"), F.lit(5)))
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 100
    try:
        g = mixing.mix(d, F.col("n")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    finally:
        mixing.BUCKET_ROWS = old
    assert all(0 <= r.g - r.t <= 50 for r in g)


def test_mixing_takes_the_border_document_in_part(spark):
    d = spark.createDataFrame([(1, "a", 1000), (2, "b", 30), (3, "b", 5000), (4, "b", 40), (5, "c", 700), (6, "c", 7)], "doc_id long, source string, n long")
    rows = mixing.mix(d, F.col("n")).collect()
    for s in "abc":
        g = [r for r in rows if r.source == s]
        assert 0 <= g[0].target - sum(r.taken for r in g) < 1 and all(0 <= r.taken <= 3 * r["size"] for r in g)


def test_decontamination(spark, empty):
    item = "Anna Smith said that Tom bought 12 apples for 3 dollars and later gave 4 apples to Maria so how many apples did Tom keep at home"
    other = "the quick brown fox jumps over the lazy dog near the river bank every single morning in spring"
    changed = item.replace("12", "35").replace("Tom", "Peter").replace("Maria", "Lucy").replace("Smith", "Jones")
    broken = item.replace("Tom bought", "Peter bought").replace("did Tom", "did Karl")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short"), (2, other)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"intro words here. {item} tail", 0), (2, f"so {changed} then", 0), (3, f"so {broken} then", 0), (4, "nothing of the kind is here at all today my friend", 0), (5, None, 0), (6, "", 0), (7, other + ". " + other, 0)], "doc_id long, text string, item_id int"
    )
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised", (7, 2): "verbatim"}
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == {3, 4, 5, 6}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def _held(item, doc, **k):
    return [kind for *_, kind in decontam.match([doc.encode()], decontam.Index.of([(1, item.encode())]))]


def test_decontamination_names_that_begin_sentences():
    item = "Alice has 3 red apples. Bob has 5 green apples. How many apples are there?"
    assert _held(item, "Carol has 4 red apples. David has 9 green apples. How many apples are there?") == ["reparameterised"]
    assert _held(item, "Once Carol has 4 red apples. David has 9 green apples. Then how many apples are there?") == ["reparameterised"]
    assert _held(item, "Carol has 4 red apples. Carol has 9 green apples. How many apples are there?") == []  # two names become one
    assert _held(item, item) == ["verbatim"]


def test_decontamination_adds_up_over_inserted_words():
    words = [f"word{i}" for i in range(30)]
    item = " ".join(words)
    assert _held(item, " ".join(words[:15] + ["extra"] + words[15:])) == ["reparameterised"]
    assert _held(item, " ".join(words[:14] + words[15:])) == ["reparameterised"]
    # far apart, or in another order, the halves are no match
    far = [f"else{i}" for i in range(40)]
    assert _held(item, " ".join(words[:15] + far + words[15:])) == []
    assert _held(item, " ".join(words[15:] + words[:15])) == []
    story = "every day after school Tom walks to the old town library and reads 4 pages before Tom goes home for dinner"
    assert _held(story, story.replace("Tom walks", "Carl Lee walks").replace("Tom goes", "Carl goes").replace("4", "9")) == ["reparameterised"]
    assert _held(story, story.replace("Tom walks", "Carl Lee walks").replace("Tom goes", "Peter goes")) == []
    first = "Tom walks to the old town library. Mary reads 4 long pages there before going home for dinner"
    assert _held(first, first.replace("Tom", "Carl Lee").replace("Mary", "Ann Maria Jones")) == ["reparameterised"]


def test_decontamination_items_of_few_literals():
    for item in ("1 2 3 5 8 13 21 34 55 89", "Anna Tom Maria Peter Lucy Karl Jones Smith Brown", "Add 12 and 30", "2 4 6 8"):
        assert _held(item, f"some words before {item} and some after") == ["verbatim"]
        assert _held(item, "some words before 7 7 1 9 Berta Otto 4 4 and some after") == []
    assert _held("2 4 6", "2 4 6") == []


def test_decontamination_finds_reparameterised_items():
    """A generated suite: recall by kind of change, and false alarms on other questions of the same words."""
    hit, total = Counter(), Counter()
    before, after = "It was a quiet afternoon and nothing had happened there. ", " After that everybody went home and slept until the next morning."
    for change, item, text in reparam.suite():
        total[change] += 1
        hit[change] += bool(_held(item, before + text + after))
    assert min(hit[c] / total[c] for c in total) >= 0.9 and sum(hit.values()) >= 0.97 * sum(total.values())
    wrong = [bool(_held(item, text)) for item, text in reparam.chance()]
    assert sum(wrong) <= 0.01 * len(wrong)


def test_decontamination_against_loops():
    """Where all that aligns is one shift and slots are consistent, a pair matches just if enough windows meet."""
    r = random.Random(31)
    words = ["Anna", "Bob", "apples", "has", "3", "12", "kg", "5kg", "Seven", "twenty", "five", "the", "The", "red", "box", "of", "é", "Éva", "gives,", "to.", "$4", "1/2", "--", "(two)", "walks", "home"]
    both = Counter()
    for _ in range(600):
        item = " ".join(r.choice(words) for _ in range(r.randint(3, 24)))
        cut = item.split()
        a, b = sorted((r.randrange(len(cut)), r.randrange(len(cut) + 1)))
        text = " ".join(["odd", "start", "here", *cut[a:b], "odd", "end"])
        want = any(n >= need for n, _, need in brute.met(item, text))
        got = bool(_held(item, text))
        assert got == want, (item, text)
        both[want] += 1
    assert min(both.values()) > 50


def test_decontamination_join_gives_what_the_index_gives(spark):
    """A benchmark too large to broadcast meets the documents in a join."""
    r = random.Random(8)
    found = list(reparam.suite(3, 2))
    bench = spark.createDataFrame([(i, item) for i, (_, item, _) in enumerate(found)] + [(900, None), (901, "too short"), (902, "Add 12 and 30"), (None, "4 5 6 7 8 9"), (5, found[5][1])], "item_id long, text string")
    rows = [(i, text, 1, 2) for i, (_, _, text) in enumerate(found)] + [(None, found[3][2], 1, 2), (7, found[3][2], 1, 2), (500, None, 1, 2), (501, "", 1, 2), (502, "so 4 5 6 7 8 9 and Add 12 and 30 " + "filler words go here " * 300, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, `a.b` int").repartition(3)
    by_index = sorted(map(str, decontam.contaminated(docs, bench).collect()))
    kept = sorted(map(str, decontam.keep_clean(docs, bench).collect()))
    old, decontam.INDEX_BYTES = decontam.INDEX_BYTES, 100
    try:
        assert sorted(map(str, decontam.contaminated(docs, bench).collect())) == by_index and len(by_index) > len(found)
        clean = decontam.keep_clean(docs, bench)
        assert sorted(map(str, clean.collect())) == kept and clean.columns == docs.columns
        assert decontam.contaminated(docs.limit(0), bench).count() == 0
    finally:
        decontam.INDEX_BYTES = old
    assert {"verbatim", "reparameterised"} <= {x.split("kind='")[1][:-2] for x in by_index}


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>one</p>"), (2, "http://b/é\r\n", "<p>WARC/1.1\r\n\r\n</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "<p>one</p>"), (6, "u", "été\n" * 50), (9, "v", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    keeper = {"<p>one</p>": 9, "": 4}
    for i, _, h in rows:
        data = (h or "").encode()
        ref = keeper.get(h or "", i)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if ref == i else ("revisit", ref))
    assert warc.round_trip(pages.limit(0)).count() == 0


def _archive(n=6, zipped=False):
    recs = [warc.record(i, f"http://h/{i}", f"payload {i} ".encode() * (i + 1), warc.sha1_base32(f"payload {i} ".encode() * (i + 1))) for i in range(n)]
    return [gzip.compress(r, mtime=0) for r in recs] if zipped else recs


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop"])
def test_salvage_recovers_all_other_records(zipped, damage):
    recs = _archive(6, zipped)
    bad = recs[2]
    bad = {"flip": bad[: len(bad) // 2] + bytes([bad[len(bad) // 2] ^ 0xFF]) + bad[len(bad) // 2 + 1 :], "cut": bad[: len(bad) - 9], "junk": b"\x00\xffnoise" + bad, "drop": b"WARC/1.1\r\nbroken"}[damage]
    data = b"".join([*recs[:2], bad, *recs[3:]])
    got, gaps = warc.salvage(data)
    # a member cut in its trailer has lost no byte of its record, and the block digest proves it
    want = [0, 1, 2, 3, 4, 5] if damage == "junk" or (zipped and damage == "cut") else [0, 1, 3, 4, 5]
    assert [r.headers["warc-record-id"] for r in got] == [warc.record_id(i) for i in want]
    assert len(gaps) == 1 and gaps[0].offset == len(recs[0]) + len(recs[1])
    assert sum(b for _, b in {(r.offset, r.length) for r in got}) + gaps[0].length == len(data)


def test_members_end_in_zero_and_inflate():
    small, large = warc.member(b"x" * 100), warc.member(bytes(17 << 20))
    assert small.endswith(b"\0") and large.endswith(b"\0") and gzip.decompress(small) == b"x" * 100 and gzip.decompress(large) == bytes(17 << 20)
    assert warc.salvage(gzip.compress(b"")) == ([], [])


def test_salvage_of_truncated_and_empty():
    recs = _archive(3)
    got, gaps = warc.salvage(b"".join(recs)[:-20])
    assert len(got) == 2 and gaps[0].reason == "truncated"
    assert warc.salvage(b"") == ([], [])


def test_salvage_inside_a_member():
    recs = _archive(6)
    bad = recs[2][:-9]
    whole = gzip.compress(b"".join([*recs[:2], bad, *recs[3:]]), mtime=0)
    got, gaps = warc.salvage(whole)
    assert [r.headers["warc-record-id"] for r in got] == [warc.record_id(i) for i in (0, 1, 3, 4, 5)]
    assert [(g.offset, g.length, g.inside) for g in gaps] == [(0, len(whole), (len(recs[0]) + len(recs[1]), len(bad)))]
    # a member that breaks gives what it holds before that, and later members are found
    for cut in range(20, len(whole), 37):
        got, gaps = warc.salvage(whole[:cut] + gzip.compress(recs[5], mtime=0))
        ids = [r.headers["warc-record-id"] for r in got]
        assert ids[-1] == warc.record_id(5) and ids[:-1] == [warc.record_id(i) for i in (0, 1, 3, 4, 5)][: len(ids) - 1]
        assert [(g.offset, g.length) for g in gaps if not g.inside] == [(0, cut)]
    assert len(warc.salvage(whole[:-8])[0]) == 5
    broken = bytearray(gzip.compress(b"".join(warc.record(i, "u", random.Random(i).randbytes(9000), "x") for i in range(40)), mtime=0))
    broken[len(broken) // 2] ^= 0x55
    got, gaps = warc.salvage(bytes(broken))
    assert 19 <= len(got) < 40 and all(r.checked for r in got) and len(gaps) == 1


@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("damage", ["crc", "size", "cut", "middle"])
def test_salvage_gives_what_inflates_once(level, damage):
    """A broken member of stored or of incompressible records: each record that inflates whole, once, the last one too."""
    for n, noise in ((1, 20_000), (3, 0), (6, 20_000), (40, 300)):
        r = random.Random(n)
        bodies = [r.randbytes(noise) if noise else f"text {i} ".encode() * 30 for i in range(n)]
        recs = [warc.record(i, f"http://h/{i}", b, warc.sha1_base32(b)) for i, b in enumerate(bodies)]
        z = bytearray(gzip.compress(b"".join(recs), level, mtime=0))
        if damage == "cut":
            del z[-5:]
        else:
            z[{"crc": -8, "size": -1, "middle": len(z) // 2}[damage]] ^= 0x55
        after = gzip.compress(warc.record(99, "u", b"later", "x"), mtime=0)
        got, gaps = warc.salvage(bytes(z) + after)
        ids = [x.headers["warc-record-id"] for x in got]
        assert len(set(ids)) == len(ids) and ids[-1] == warc.record_id(99)
        if damage != "middle":
            assert ids[:-1] == [warc.record_id(i) for i in range(n)]
        assert [(g.offset, g.length) for g in gaps if not g.inside] == [(0, len(z))]


def test_equal_records_in_sound_members_stay():
    rec = warc.record(1, "u", b"same", "x")
    broken = bytearray(gzip.compress(rec, 0, mtime=0))
    broken[-8] ^= 1
    got, _ = warc.salvage(bytes(broken) + rec + gzip.compress(rec, mtime=0))
    assert len(got) == 3


def test_salvage_accounts_for_every_byte():
    r = random.Random(21)
    for _ in range(60):
        parts = []
        for i in range(8):
            rec = warc.record(i, "http://h/\r\n", b"WARC/1.1\r\n\r\n" + r.randbytes(r.randint(0, 300)), "x")
            rec = rec if r.random() < 0.4 else gzip.compress(rec, mtime=0) if r.random() < 0.7 else gzip.compress(rec + rec[: r.randint(0, len(rec))] + rec, mtime=0)
            if r.random() < 0.4:
                at = r.randrange(len(rec))
                rec = r.choice([rec[:at], rec[:at] + bytes([rec[at] ^ 1 << r.randrange(8)]) + rec[at + 1 :], r.randbytes(30) + rec])
            parts.append(rec)
        data = b"".join(parts)
        got, gaps = warc.salvage(data)
        spans = {(x.offset, x.length) for x in [*got, *gaps] if x.length}
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == len(data)


def test_salvage_searches_once():
    import time

    rec, took = _archive(1)[0], []
    for n in (40_000, 160_000):
        junk = b"WARC/ \x1f\x8b\x08 WARC/1.1\r\nabc " * n
        began = time.perf_counter()
        got, gaps = warc.salvage(rec + junk + rec)
        took.append(time.perf_counter() - began)
        assert len(got) == 2 and [(g.offset, g.length) for g in gaps] == [(len(rec), len(junk))]
    assert took[1] < 10 * took[0] + 1


def test_read_of_a_large_archive_and_clashing_columns(spark, tmp_path):
    """Over 64 MB in a file, through Spark's reader alone."""
    r = random.Random(5)
    with open(tmp_path / "large.warc", "wb") as f:
        for i in range(24):
            f.write(warc.record(i, None, r.randbytes(3_000_000), "x") + (b"junk" if i == 7 else b""))
    assert (tmp_path / "large.warc").stat().st_size > 64 << 20
    got = warc.read(spark, f"file://{tmp_path}", with_payload=False).collect()
    assert sorted(x.record_id for x in got if x.gap is None) == sorted(warc.record_id(i) for i in range(24)) and [x.length for x in got if x.gap] == [4]
    pages = spark.createDataFrame([(1, "u", "one", 5, "x", "y"), (2, "v", "one", 6, "x", "y"), (None, "w", "one", 7, "x", "y"), (2, "v", "one", 6, "x", "y")], "page_id long, url string, html string, digest int, keeper string, `a.b` string")
    got = sorted((str(x.page_id), x.record_type, x.refers_to) for x in warc.round_trip(pages).collect())
    assert got == [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "revisit", 2)]


def test_url_filter(spark):
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.good.com/{word('abcde')}") if i % 2 else (i, f"https://{word('vwxyz')}.bad.net/p/{word('vwxyz')}?q=1") for i in range(400)]
    rows += [(1000 + i, f"http://{word('abcde')}.other.org/{word('abcde')}" if i % 2 else f"http://{word('vwxyz')}.other.org/{word('vwxyz')}") for i in range(100)]
    rows += [(2000, None), (2001, "no scheme/x"), (2002, "HTTP://GOOD.com#f"), (2003, "x://sub.GOOD.com/deny/1?u"), (2004, ""), (2005, "a://xgood.com/deny/1")]
    rules = [url_filter.rule("good.com", True), url_filter.rule("bad.net/", False), url_filter.rule("good.com/deny/", False)]
    got = {x.page_id: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows)
    assert (got[2000].host, got[2000].path, got[2000].rule) == ("", "", None) == (got[2001].host, got[2001].path, got[2001].rule)
    assert (got[2002].host, got[2002].path, got[2002].rule, got[2002].verdict) == ("good.com", "", "good.com", "allow")
    assert (got[2003].host, got[2003].path, got[2003].rule, got[2003].verdict) == ("sub.good.com", "/deny/1", "good.com/deny/", "block")
    assert got[2005].rule is None
    right = sum((got[1000 + i].verdict == "allow") == bool(i % 2) for i in range(100))
    assert right >= 95
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_toxicity_finds_recurring_words():
    r = random.Random(8)
    vocab = vocabulary(5, 3000)
    bad = ["horridword", "nastything", "vilestuff", "grimfoe"]
    doc = lambda extra: " ".join(r.sample([r.choice(vocab) for _ in range(80)] + extra, 80 + len(extra))).encode()
    tox = [doc([r.choice(bad) for _ in range(3)]) for _ in range(160)]
    ok = [doc([]) for _ in range(400)]
    m = toxicity.train(tox[:120], ok[:300])
    assert (toxicity.scores(tox[120:], m) >= 0.5).mean() > 0.95 and (toxicity.scores(ok[300:], m) >= 0.5).mean() < 0.03
    assert (toxicity.scores([None, b"", b" "], m) < 0.5).all()
    assert toxicity.train([], ok).coef == ()


def test_toxicity_tables(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    assert toxicity.keep_clean(docs, m).columns == docs.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0.0 and toxicity.score(empty, m).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in KINDS.items():
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(g) <= 19 and luhn(g), "phone": lambda: 8 <= len(g) <= 15}[k]():
                out.append((k, m.start(), m.end()))
    return out


def test_pii_against_brute_force(spark):
    r = random.Random(6)
    alphabet = ["1", "2", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "@", ".", "a", "b.c", "x_y@d.e", "-", " ", "é", "+1 (555) 010-9999", "+", "(", "255.1.2.3", "256.1.1.1", "1.2.3.4.5.6.7.8", "\n", "00", "%", "5500000000000004"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += [None, "", "a@b.c " * 700, "1" * 5000, "a." * 5000, "a@b.c_x@foo.com", "x" * 20000 + "@", "+1" + " " * 3000, "a@" * 2000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in pii.digest(d).collect():
        want = base_spans(texts[g.doc_id] or "")
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), texts[g.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in want) for k in KINDS]
        mine = set(g.spans.split(",")) if g.spans else set()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= mine


def test_pii_added_kinds_and_redaction(spark, empty):
    t = ["IBAN DE89370400440532013000 or DE89370400440532013001", "call 555-010-9999 now", "part 555-010-9999 now", "mail a@b.co é x@y.org!", "nothing", None]
    d = spark.createDataFrame([(i, x, "en", "s", len(x) if x else None) for i, x in enumerate(t)], "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.digest(d).collect()}
    assert spans == {0: "iban:5:27", 1: "phone:5:17", 2: "", 3: "email:5:11,email:14:21", 4: "", 5: ""}
    out = {r.doc_id: r for r in pii.redact(d).collect()}
    assert out[3].text == "mail <EMAIL> é <EMAIL>!" and out[3].n_chars == len(out[3].text)
    assert out[0].text == "IBAN <IBAN> or DE89370400440532013001" and out[5].text is None and out[4].text == "nothing"
    assert pii.digest(empty).count() == 0 and pii.redact(empty).columns == empty.columns


def test_redaction_leaves_no_character_of_a_span(spark):
    """Hundreds of spans inside one another, against a loop over all spans that detection found."""
    r = random.Random(12)
    alphabet = ["1.1.1.1.", "2.2.2.2", "a@b.co", "+1 (555) 010-9999", " ", ".", "x", "é", "@c.org", "4111 1111 1111 1111 ", "DE89370400440532013000"]
    texts = ["mail " + "1.1.1.1." * n + "secret@corp.example.org end" for n in (1, 63, 64, 65, 80, 127, 128, 129, 300)] + ["a@b.co " * 700, None, "", "plain"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, 0, "mine", "k", "n", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, base string, _k0 string, _new string, `a.b` int")
    found = {x.doc_id: x.spans for x in pii.detect(d.select("doc_id", "text")).collect()}
    got = pii.redact(d)
    assert got.columns == d.columns
    for x in got.collect():
        t = texts[x.doc_id]
        assert (x.base, x._k0, x._new, x["a.b"]) == ("mine", "k", "n", 7)
        if not found[x.doc_id]:
            assert x.text == t and x.n_chars == 0
            continue
        out, past = [], 0
        for s in sorted(found[x.doc_id], key=lambda s: (s.start, -s.end)):
            if s.end > past:
                out += [t[past : max(past, s.start)], f"<{s.kind.upper()}>"]
            past = max(past, s.end)
        assert x.text == "".join(out) + t[past:] and x.n_chars == len(x.text)
        if t.startswith("mail "):
            assert x.text == "mail <EMAIL> end"


def test_langid(spark, empty):
    r = random.Random(2)
    vocab = {x: vocabulary(k, 200) for k, x in enumerate(["en", "de", "fr", "es"])}
    rows = [(i, " ".join(r.choice(vocab[x]) for _ in range(60)), x) for i, x in enumerate(r.choice(list(vocab)) for _ in range(600))]
    rows += [(700, None, "en"), (701, "123 456", "en"), (702, "", None), (703, " ".join(vocab["fr"][:50]), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(d)
    got = {x.doc_id: x for x in langid.identify(d, m).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (700, 701, 702)) and got[703].lang_pred == "fr"
    held = [i for i, _, _ in rows[:600] if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert langid.identify(d, None).where("lang_pred != 'und'").count() == 0 and langid.identify(empty, m).count() == 0
    assert langid.family("es") == "romance" and langid.family("xx") == "xx" and langid.family("en-US") == langid.family("deu") == langid.family("nl_BE") == "germanic"


def test_a_number_stands_for_two_values_at_most(spark):
    item = "take 4 eggs then 4 cups of flour then 4 spoons of sugar and 4 pinches of salt to bake the old cake"
    texts = [item.replace("4", "9"), item.replace("4 eggs", "7 eggs").replace("4 c", "8 c").replace("4 s", "8 s").replace("4 p", "8 p"), item.replace("4 eggs", "5 eggs").replace("4 cups", "6 cups").replace("4 spoons", "7 spoons").replace("4 pinches", "8 pinches")]
    bench = spark.createDataFrame([(1, item), (2, "What is 12 of 30")], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (9, "so what is 3 of 9 then"), (10, "so what is 12 of 30 then")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(0, 1), (1, 1), (10, 2)]


def test_samples_are_exact_at_any_count(spark):
    rows = [(7, "same text", "a")] * 3000 + [(i, f"t{i}", "b") for i in range(2500)] + [(None, None, "c")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = kern.sampled(d, "lang", {"a": 40, "b": 100, "c": 40, "x": 3}, "doc_id", "text").collect()
    assert Counter(r.lang for r in got) == {"a": 40, "b": 100, "c": 5}
    again = kern.sampled(d.repartition(3), "lang", {"a": 40, "b": 100, "c": 40}, "doc_id", "text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert d.where(kern.lower_part(1.0, "doc_id")).count() == len(rows)
    # a share far below one in a million still has its part of the hash range
    n = spark.range(1 << 21).where(kern.lower_part(3e-6, "id")).count()
    assert 0 < n < 40


def test_fingerprints_are_dealt_in_bounded_batches():
    """A task's copies never meet in one batch, and every two sub-tiles of a class or of adjacent ones meet once."""
    held, r = {3: 40, 4: 50, 5: 2}, np.random.default_rng(3)
    rows = [(z, s, [x.tobytes() for x in r.integers(0, 2**63, (500, 4), dtype=np.uint64)]) for z in held for s in range(held[z])]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["size", "sub", "l"])
    met = Counter()
    for out in simhash.deal_by_size([batch], held):
        assert out.nbytes < 2 * simhash.DEAL
        met.update(zip(out.column("job").to_pylist(), out.column("own").to_pylist()))
    want = Counter()
    for z in held:
        want.update((f"{z},{i},{z},{j}", own) for i in range(held[z]) for j in range(i, held[z]) for own in ({True} if i == j else {True, False}))
        want.update((f"{z},{i},{z + 1},{j}", own) for i in range(held[z]) for j in range(held.get(z + 1, 0)) for own in (True, False))
    assert met == want
