"""Source divergence audit: how the sources of a language differ in their words, counted in mergeable radix tries.

1. A task counts terms in one radix trie a language, keyed by UTF-8 bytes.  A trie is laid out in preorder, which is byte order:
   for each leaf how many bytes of its path it shares with the leaf before, and the bytes of its own; beside it the
   documents that have the term and a counter for each source.  Tries of blocks of text merge until they hold
   `LEAVES`; then the task sends them, cut into subtries by prefix.
2. Subtries of one prefix are one range.  A prefix whose subtries hold over `RANGE` leaves is cut again, one byte deeper,
   until none does, so a range fits a task whatever the script.  Subtries of a range merge, and terms of too few
   documents go.
3. Sums over the leaves give each source's and language's totals.  Each range then meets the totals of its language and
   is traversed once more in byte order.  The traversal adds up divergences of pairs of sources and keeps each source's
   best terms, earlier terms first among equals.
4. Spark adds the ranges' sums and ranks.

A pair's sum runs over all kept terms, also those neither source has.  A range therefore adds, for terms of both
sources, the difference to what either has against a count of zero; for terms of one, that against zero; and the
constant of two zeros once for each term at the end.  So its work is in the counters that exist, not in terms times pairs.
The result holds all pairs of a language's sources, so its size is the square of their number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import kern, scratch

LEAST_DOCS, TOP = 10, 10
#: Leaves at which a task's tries are merged and sent, leaves of a range before they merge, bytes of text counted at once.
LEAVES, RANGE, BLOCK = 1_000_000, 250_000, 4 << 20
#: Prefixes to cut deeper that are broadcast; there is at most one for each RANGE leaves.
MOST_LARGE = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BLOBS = ("shared", "size", "data", "docs", "counters", "source", "counts")
_TRIE = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int64()), ("names", pa.list_(pa.string())), *((c, pa.binary()) for c in _BLOBS)])
_TRIE_SQL = "lang string, prefix binary, leaves long, names array<string>, " + ", ".join(f"{c} binary" for c in _BLOBS)
_LEAF = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_LEAF_SQL = "lang string, prefix binary, term binary, docs long, sources array<string>, counts array<long>"
_SUM = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_SUM_SQL = "lang string, source string, part string, item string, value long"


def _spans(terms: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of terms, and where each begins and ends."""
    _, offsets, data = terms.buffers()
    at = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _binary(parts: list[bytes]) -> pa.LargeBinaryArray:
    return pa.array(parts, pa.large_binary())


@dataclass
class Trie:
    """Leaves in byte order: terms, documents, counters a leaf, and the counters' sources (in `names`) and counts, leaf after leaf."""

    terms: pa.LargeBinaryArray
    docs: np.ndarray
    counters: np.ndarray
    source: np.ndarray
    counts: np.ndarray
    names: list[str]

    @staticmethod
    def of(terms: pa.LargeBinaryArray, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, counts: np.ndarray, names: list[str]) -> Trie:
        """A trie of terms in any order, which may repeat; counter k belongs to terms[leaf[k]]."""
        held = terms.dictionary_encode()
        order = pc.sort_indices(held.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[held.indices.to_numpy()]
        total = np.zeros(len(order), np.int64)
        np.add.at(total, place, docs)
        key = place[leaf] * len(names) + source
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        sums = np.add.reduceat(counts[by], first) if len(first) else np.zeros(0, np.int64)
        u = key[by][first]
        return Trie(held.dictionary.take(pa.array(order)), total, np.bincount(u // max(1, len(names)), minlength=len(order)), u % max(1, len(names)), sums, names)

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        names = sorted({n for t in tries for n in t.names})
        at = {n: k for k, n in enumerate(names)}
        source = np.concatenate([np.array([at[n] for n in t.names], np.int64)[t.source] for t in tries])
        base = np.cumsum([0, *(len(t.terms) for t in tries)])
        leaf = np.concatenate([np.repeat(np.arange(len(t.terms)) + b, t.counters) for t, b in zip(tries, base)])
        return Trie.of(pa.concat_arrays([t.terms for t in tries]), np.concatenate([t.docs for t in tries]), leaf, source, np.concatenate([t.counts for t in tries]), names)

    def common(self) -> np.ndarray:
        """Bytes that each leaf's path shares with the one before, byte by byte for those still equal."""
        data, at = _spans(self.terms)
        begin, size = at[:-1], np.diff(at)
        out = np.zeros(len(size), np.int64)
        live, depth = np.arange(1, len(size)), 0
        while len(live):
            live = live[np.minimum(size[live], size[live - 1]) > depth]
            live = live[data[begin[live] + depth] == data[begin[live - 1] + depth]]
            depth += 1
            out[live] = depth
        return out

    def rows(self, lang: str, depth: int) -> pa.RecordBatch:
        """The subtries of all prefixes of `depth` bytes (shorter terms are their own)."""
        shared = self.common()
        cut = np.flatnonzero(np.where(np.arange(len(shared)) == 0, True, shared < depth))
        data, at = _spans(self.terms)
        own = self.counters.cumsum()
        out: dict[str, list] = {f.name: [] for f in _TRIE}
        shared[cut] = 0
        size = np.diff(at) - shared
        begin = at[:-1] + shared
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(shared)]):
            lo, hi = (own[a - 1] if a else 0), (own[b - 1] if b else 0)
            keep = np.zeros(at[b] - at[a] + 1, np.int8)
            np.add.at(keep, begin[a:b] - at[a], 1)
            np.add.at(keep, at[a + 1 : b + 1] - at[a], -1)
            used, source = np.unique(self.source[lo:hi], return_inverse=True)
            out["lang"].append(lang)
            out["prefix"].append(data[at[a] : min(at[a + 1], at[a] + depth)].tobytes())
            out["leaves"].append(b - a)
            out["names"].append([self.names[k] for k in used])
            blobs = (shared[a:b].astype("<u4"), size[a:b].astype("<u4"), data[at[a] : at[b]][np.cumsum(keep[:-1]) > 0], self.docs[a:b].astype("<i8"), self.counters[a:b].astype("<u4"), source.astype("<u4"), self.counts[lo:hi].astype("<i8"))
            for c, x in zip(_BLOBS, blobs):
                out[c].append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _TRIE], schema=_TRIE)

    @staticmethod
    def read(row: dict) -> Trie:
        """A subtrie of a row; a path is what it shares with the one before and its own bytes."""
        b = {c: np.frombuffer(row[c], "<i8" if c in ("docs", "counts") else "<u4").astype(np.int64) for c in _BLOBS if c != "data"}
        terms, path, at, data = [], b"", 0, row["data"]
        for shared, size in zip(b["shared"].tolist(), b["size"].tolist()):
            path = path[:shared] + data[at : at + size]
            at += size
            terms.append(path)
        return Trie(_binary(terms), b["docs"], b["counters"], b["source"], b["counts"], row["names"])


def terms(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Distinct terms of texts, and for each occurrence its term and its text."""
    low = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes.lower changes A-Z only
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = _LETTER[low]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    data = np.ascontiguousarray(low[inside[1:-1].view(bool)])
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    count = np.diff(np.append(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]), len(start)))
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), count)


def block_tries(langs: list[str], sources: list[str], texts: list[bytes]) -> dict[str, Trie]:
    """A trie for each language of a block; the empty term has all sources with a count of zero."""
    names, lang_names = sorted(set(sources)), sorted(set(langs))
    s, g = np.searchsorted(names, sources), np.searchsorted(lang_names, langs)
    found, term, text = terms(texts)
    n, k = len(texts), len(lang_names)
    u = np.unique(term * n + text)  # a term and a text that has it
    leaf, docs = np.unique(u // n * k + g[u % n], return_counts=True)
    both, counts = np.unique((term * k + g[text]) * len(names) + s[text], return_counts=True)
    out = {}
    for x, lang in enumerate(lang_names):
        own = leaf[leaf % k == x]
        mine = both[both // len(names) % k == x]
        seen = np.unique(s[g == x])
        place = np.concatenate([np.searchsorted(own, mine // len(names)), np.full(len(seen), len(own))])
        held = pa.concat_arrays([found.take(pa.array(own // k)), _binary([b""])])
        total = np.concatenate([counts[both // len(names) % k == x], np.zeros(len(seen), np.int64)])
        out[lang] = Trie.of(held, np.append(docs[leaf % k == x], 0), place, np.concatenate([mine % len(names), seen]), total, names)
    return out


def _count(batches):
    held: dict[str, list[Trie]] = {}
    size = 0

    def sent():
        for lang, tries in held.items():
            yield Trie.merged(tries).rows(lang, 1)

    for batch in batches:
        for lo, hi, texts in kern.text_blocks(batch.column(2), BLOCK):
            for lang, trie in block_tries(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), texts).items():
                held.setdefault(lang, []).append(trie)
                size += len(trie.terms)
            if size > LEAVES:
                held = {lang: [Trie.merged(tries)] for lang, tries in held.items()}
                size = sum(len(t[0].terms) for t in held.values())
                if 2 * size > LEAVES:
                    yield from sent()
                    held, size = {}, 0
            pa.default_memory_pool().release_unused()
    yield from sent()


def _deeper(depth):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield Trie.read(row).rows(row["lang"], depth)

    return run


def _merge(least_docs):
    def run(key, tab):
        t = Trie.merged([Trie.read(row) for row in tab.to_pylist()])
        size = pc.binary_length(t.terms).to_numpy(zero_copy_only=False)
        keep = (t.docs >= least_docs) | (size == 0)
        live = np.repeat(keep, t.counters)
        ends = np.concatenate([[0], np.cumsum(t.counters[keep])])
        names = pa.array(t.names, pa.string()).take(pa.array(t.source[live]))
        columns = {"lang": pa.repeat(key[0], int(keep.sum())), "prefix": pa.repeat(key[1], int(keep.sum())), "term": t.terms.filter(pa.array(keep)).cast(pa.binary()), "docs": t.docs[keep]}
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (names, pa.array(t.counts[live], pa.int64()))]
        return pa.Table.from_arrays([*(pa.array(columns[c], _LEAF.field(c).type) if c == "docs" else columns[c] for c in columns), *lists], schema=_LEAF)

    return run


def share(count: np.ndarray, n: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / (n + 2 kept)), three digits at a time so that nothing overflows."""
    whole = np.asarray(n, np.int64) + 2 * kept
    q, r = np.divmod(np.asarray(count, np.int64) + 2, whole)
    for _ in range(3):
        d, r = np.divmod(r * 1000, whole)
        q = q * 1000 + d
    return q + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def traverse(lang: str, words: list[bytes], sizes: np.ndarray, source: np.ndarray, count: np.ndarray, names: list[str], totals: np.ndarray, kept: int, top: int):
    """Sums and best terms of a language's range: `words` in byte order with `sizes` counters each, `source` an index of `names`."""
    term = np.repeat(np.arange(len(words)), sizes)
    live = count > 0
    term, source, count = term[live], source[live], count[live]
    p, zero = share(count, totals[source], kept), share(np.zeros(len(names), np.int64), totals, kept)
    whole = np.zeros(len(words), np.int64)
    np.add.at(whole, term, count)
    q = share(whole, int(totals.sum()), kept)[term]
    good = np.flatnonzero(p > q)
    value = apart(p[good], q[good])
    by = np.lexsort((term[good], -value, source[good]))
    s = source[good][by]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    best = by[rank < top]
    yield from ((lang, names[source[good[i]]], "term", words[term[good[i]]].decode("utf-8", "replace"), int(value[i])) for i in best)
    by = np.argsort(source, kind="stable")
    term, source, count, p = term[by], source[by], count[by], p[by]
    mark = np.zeros(len(words), np.int64)
    cut = np.searchsorted(source, np.arange(len(names) + 1))
    for a in np.flatnonzero(np.diff(cut)).tolist():
        own = slice(cut[a], cut[a + 1])
        row = np.zeros(len(names), np.int64)
        u, many = np.unique(count[own], return_counts=True)
        pu = share(u, int(totals[a]), kept)
        step = max(1, 1_000_000 // len(names))
        for i in range(0, len(u), step):
            row += (many[i : i + step, None] * apart(pu[i : i + step, None], zero)).sum(axis=0)
        row -= many.sum() * apart(zero[a], zero)
        mark[term[own]] = p[own]
        rest = slice(cut[a + 1], None)
        hit = np.flatnonzero(mark[term[rest]])
        b, pa_, pb = source[rest][hit], mark[term[rest][hit]], p[rest][hit]
        if len(b):
            both = apart(pa_, pb) - apart(pa_, zero[b]) - apart(zero[a], pb) + apart(zero[a], zero[b])
            first = np.flatnonzero(np.diff(b, prepend=-1))
            row[b[first]] += np.add.reduceat(both, first)
        mark[term[own]] = 0
        row[a] = 0
        yield from ((lang, names[a], "pair", names[i], int(row[i])) for i in np.flatnonzero(row))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Divergence of all pairs of a language's sources, and each source's `top` terms against its language.

    Takes text, lang and source; other columns are ignored, whatever their names.  Null text, lang and source are ''.
    Returns lang, source, part (`pair` or `term`), item (the other source, or the term), value and rank.  Terms are runs
    of ASCII letters and of characters from U+0080 on, only A-Z lower-cased; a language keeps those in at least
    `least_docs` of its documents.  Equal values rank by item in UTF-8 order; repeated rows are documents of their own.
    A language without kept terms has pairs of value 0 and no terms; one with a single source has no pairs.  A
    language's sources are the one thing a task holds whole.  An empty table gives an empty table.
    """
    text = [F.coalesce(c, F.lit("")) for c in kern.cols(["lang", "source", "text"])]
    tries = scratch.stored(docs.select(text[0].alias("lang"), text[1].alias("source"), text[2].cast("binary").alias("text")).mapInArrow(_count, _TRIE_SQL), "audit-tries")
    parts, depth = [], 1
    while True:
        large = tries.groupBy("lang", "prefix").agg(F.sum("leaves").alias("all")).where((F.col("all") > RANGE) & (F.octet_length("prefix") == depth)).select("lang", "prefix")
        large = scratch.stored(large, "audit-large")
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= MOST_LARGE else large
        parts.append(tries.join(large, ["lang", "prefix"], "left_anti"))
        depth += 1
        tries = scratch.stored(tries.join(large, ["lang", "prefix"], "left_semi").select(*_TRIE.names).mapInArrow(_deeper(depth), _TRIE_SQL), "audit-tries")
    for part in parts:
        tries = tries.unionByName(part)
    merged = scratch.stored(tries.select(*_TRIE.names).groupBy("lang", "prefix").applyInArrow(_merge(least_docs), _LEAF_SQL), "audit-merged")
    words = merged.where(F.octet_length("term") > 0)
    kept = words.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    totals = scratch.stored(totals.join(kept, "lang", "left").select("lang", "source", "total", F.coalesce("kept", F.lit(0)).cast("long").alias("kept")), "audit-totals")

    def walk(key, tab, stats):
        of, part = stats.sort_by("name").combine_chunks(), tab.sort_by("term").combine_chunks()
        lists, counts = (part.column(c).combine_chunks() for c in ("sources", "counts"))
        source = pc.index_in(lists.flatten(), value_set=of.column("name").combine_chunks()).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        rows = list(traverse(key[0].as_py(), part.column("term").to_pylist(), sizes, source.astype(np.int64), counts.flatten().to_numpy(), of.column("name").to_pylist(), of.column("n").to_numpy(), of.column("v")[0].as_py(), top))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUM)], schema=_SUM) if rows else _SUM.empty_table()

    held = words.select(F.col("lang").alias("of"), F.col("prefix").alias("at")).distinct()
    stats = totals.join(held, F.col("lang") == F.col("of")).select("of", "at", F.col("source").alias("name"), F.col("total").alias("n"), F.col("kept").alias("v"))
    sums = words.groupBy("lang", "prefix").cogroup(stats.groupBy("of", "at")).applyInArrow(walk, _SUM_SQL)
    sums = scratch.stored(sums, "audit-sums")
    a, b = totals.select("lang", "kept", *(F.col(c).alias(f"{c}_a") for c in ("source", "total"))), totals.select("lang", *(F.col(c).alias(f"{c}_b") for c in ("source", "total")))
    zero = [f"(1 + 2000000000 div (total_{x} + 2 * kept))" for x in "ab"]
    none = f"CASE WHEN kept > 0 THEN kept * (({zero[0]} - {zero[1]}) * ({zero[0]} - {zero[1]}) div ({zero[0]} + {zero[1]})) ELSE 0 END"
    pairs = a.join(b, "lang").where("source_a < source_b").select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.expr(none).alias("value"))
    found = sums.where("part = 'pair'").select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "value")
    pairs = pairs.unionByName(found).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    pairs = pairs.select("lang", "value", both).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    best = sums.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(best)
