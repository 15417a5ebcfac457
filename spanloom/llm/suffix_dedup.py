"""Suffix-array dedup: a family of suffix arrays in levels of doubling size, merge-scanned for long matches.

A match is `length` bytes.  Suffixes are indexed where the text itself says so: of the `gram`-byte
strings inside a window of `length` bytes the one with the least hash, leftmost, is the window's
anchor.  Equal windows have equal anchors, and the windows of one anchor start side by side, so one
entry (the suffix at the anchor, with the bytes before it that its windows reach) stands for about
70 windows, and two entries hold equal windows exactly if they agree on `o` bytes before the anchor
and on `length - o` from it on, for an o that both have.

1. Documents are dealt into chunks by a hash of doc_id and text.  A chunk sends each distinct hash of
   an anchor's gram once to a bucket, which answers with those that occur elsewhere; the others
   cannot match and their texts never move.
2. Chunks send the entries that are left, each distinct one once, to the bucket of their gram's hash.
3. A bucket is an index family.  Entries come in batches of `BATCH`; a new batch gets its suffix array,
   is scanned, and takes the lowest free level.  Where that is taken, the equal-sized levels are
   merged into the next and the merged array is scanned, so each pair of batches meets in exactly one
   scan and each entry in a logarithmic number of them.  Entries that are equal leave one of them.
4. A scan reads common prefixes of neighbours in the suffix array and of neighbours in the array of
   reversed left contexts: for each o, entries of one run in both arrays hold one window.
5. Chunks meet their answers, and bytes under a repeated window go.

A gram with over `HOT` distinct entries (the edge of a passage that very many documents hold) would
fill one bucket.  Its windows go to buckets by their own 64-bit hashes instead, each distinct one once
from a chunk, so that the common ones are few and the others spread; the result is the same but for
the chance of equal hashes, n**2 / 2**65 over n windows.  Hashes of 64 bits also tell a chunk's distinct
entries apart.  Texts, hashes, entries and answers move; nothing but the sum of text sizes is collected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern

LENGTH = 200
CHUNK_BYTES, BUCKET_BYTES, LEAST = 4 << 20, 8 << 20, 48
#: Entries of a new batch, and distinct entries of a gram beyond which its windows are dealt by their own hashes.
BATCH, HOT = 4096, 20_000
#: Window starts handled at once; positions inside fit 20 bits together with the widest window.
SLICE = 1 << 19

_POS = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0x9FB21C651E98DF25)
_NONE = np.zeros(0, np.uint64)

_GRAMS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])
_MET = pa.schema([("chunk", pa.int32()), ("grams", pa.binary()), ("hot", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("heads", pa.binary()), ("data", pa.binary()), ("once", pa.binary()), ("many", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int32()), ("cover", pa.binary()), ("windows", pa.binary()), ("hot", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"

#: An entry on its way: identity, gram, bytes before the anchor, the least of its windows' offsets, bytes in all, whether its chunk holds it twice.
_HEAD = np.dtype([("fp", "<u8"), ("gram", "<u8"), ("left", "<u2"), ("least", "<u2"), ("size", "<u4"), ("many", "u1")])
#: An answer: entry and the least and most offset of its repeated windows.
_COVER = np.dtype([("fp", "<u8"), ("least", "<u2"), ("most", "<u2")])


def gram_size(length: int) -> int:
    return max(1, length * 8 // 25)


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive keys, from running minima within blocks of w in both directions."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """Entries of a block of documents, in order: `at` (anchor), windows starting at `first`..`last`, all as places in the buffer, with `gram` and `fp` hashes."""

    def __init__(self, texts: list[bytes | None], length: int):
        texts = [t or b"" for t in texts]
        self.length, k = length, gram_size(length)
        w = length - k + 1
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        pw, inv = kern._powers(kern._BASE, SLICE + 2 * length)
        runs = []
        for a in range(0, max(0, len(self.buf) - length + 1), SLICE):
            part = self.buf[a : a + SLICE + length - 1]
            n = len(part) - length + 1
            acc = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * pw[: len(part)], out=acc[1:])
            h = (acc[k:] - acc[:-k]) * inv[: len(part) - k + 1]
            h ^= h >> np.uint64(29)
            h *= _ODD
            h ^= h >> np.uint64(32)
            h *= _ODD
            h &= ~_POS
            h |= np.arange(len(h), dtype=np.uint64)
            at = (_least(h, w) & _POS).astype(np.int64) + a
            d = np.searchsorted(self.start, [a, a + n])
            for i in range(max(0, d[0] - 1), d[1]):  # windows that would leave their document
                end = self.start[i] + self.size[i]
                at[max(0, max(self.start[i], end - length + 1) - a) : max(0, end + 1 - a)] = -1
            edge = np.flatnonzero(np.diff(at, prepend=-2, append=-2))
            runs.append(np.stack([at[edge[:-1]], edge[:-1] + a, edge[1:] + a - 1]))
        at, first, last = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
        new = np.diff(at, prepend=-2) != 0  # a run may go on in the next slice
        last = last[np.append(new[1:], True)] if len(at) else last
        at, first = at[new], first[new]
        ok = at >= 0
        self.at, self.first, self.last = at[ok], first[ok], last[ok]
        self.gram = kern.span_hashes(self.buf, self.at, self.at + k)
        text = kern.span_hashes(self.buf, self.first, self.last + length)
        self.fp = kern.mix(text ^ (self.at - self.first).astype(np.uint64) * _ODD)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of the entries `which` starts, and its hash."""
        n = (self.last - self.first + 1)[which]
        at = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        return at, kern.span_hashes(self.buf, at, at + self.length)


def _all(texts, length):
    for lo, hi in kern.blocks(texts):
        yield lo, hi, Anchors(texts[lo:hi], length)


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values seen once, and more than once."""
    u, n = np.unique(values, return_counts=True)
    return u[n == 1], u[n > 1]


def _join(parts) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else _NONE


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows padded to one width, and their lengths."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    width = int(size.max(initial=0)) + 1
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), size


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], np.minimum(at, np.minimum(size[1:], size[:-1]))])


class Family:
    """Suffix arrays in levels: level i holds 2**i batches or is empty.

    An array is a sorted list of (bytes from the anchor on, bytes before it reversed, number); `least` and
    `most` say for every number which offsets of its windows were found repeated (most < least: none).
    """

    def __init__(self, length: int, lowest: np.ndarray, highest: np.ndarray, full: np.ndarray):
        self.length, self.lowest, self.highest = length, lowest, highest
        self.least = np.where(full, lowest, length + 1)
        self.most = np.where(full, highest, -1)
        self.levels: list[list | None] = []

    def add(self, batch: list) -> None:
        """A batch in any order; scanned with itself, then with each level it is merged with."""
        batch.sort()
        array = self.scan(batch, None)
        for i, level in enumerate(self.levels):
            if level is None:
                self.levels[i] = array
                return
            array, self.levels[i] = self.merged(level, array), None
        self.levels.append(array)

    def close(self) -> None:
        """Merge what is left, smallest levels first."""
        rest = [x for x in self.levels if x is not None]
        while len(rest) > 1:
            rest[:2] = [self.merged(rest[1], rest[0])]
        self.levels = rest

    def merged(self, a: list, b: list) -> list:
        new = np.zeros(len(self.least), bool)
        new[[n for _, _, n in b]] = True
        out = a + b
        out.sort()  # two runs: one linear merge
        return self.scan(out, new)

    def scan(self, array: list, new: np.ndarray | None) -> list:
        """Note windows that entries share, in groups of one gram (with `new`: groups that hold new and old ones); returns the array with one of each set of equal entries."""
        if len(array) < 2:
            return array
        rows, size = _matrix([x[0] for x in array])
        prefix = _common(rows, size)
        head = prefix < gram_size(self.length)
        group = np.cumsum(head)
        number = np.fromiter((x[2] for x in array), np.int64, len(array))
        top = np.flatnonzero(head)
        meets = np.diff(np.append(top, len(array))) > 1
        if new is not None:
            side = new[number].astype(np.int8)
            meets &= np.minimum.reduceat(side, top) != np.maximum.reduceat(side, top)
        live = np.flatnonzero(meets[group - group[0]])
        if len(live):
            self._share(number[live], group[live], np.where(head[live], -1, prefix[live]), [array[i][1] for i in live])
        return [array[0], *(b for a, b in zip(array, array[1:]) if a[0] != b[0] or a[1] != b[1])]

    def _share(self, number: np.ndarray, group: np.ndarray, prefix: np.ndarray, left: list[bytes]) -> None:
        n = len(number)
        order = np.array(sorted(range(n), key=lambda i: (group[i], left[i])))
        rows, size = _matrix([left[i] for i in order])
        common = _common(rows, size)
        common[np.diff(group[order], prepend=-1) != 0] = -1
        reach = np.maximum(prefix, np.append(prefix[1:], -1))  # the most that any other entry shares, on either side
        back = np.empty(n, np.int64)
        back[order] = np.maximum(common, np.append(common[1:], -1))
        lowest, highest = self.lowest[number], self.highest[number]
        least, most = self.least[number], self.most[number]
        lo, hi = np.maximum(lowest, self.length - reach), np.minimum(highest, back)
        live = np.flatnonzero(lo <= hi)
        if not len(live):
            return
        before = np.empty(n, np.int64)
        for o in range(int(lo[live].min()), int(hi[live].max()) + 1):
            act = live[(lo[live] <= o) & (o <= hi[live])]
            if len(act) < 2:
                continue
            before[order] = np.cumsum(common < o)
            key = np.cumsum(prefix < self.length - o)[act] << 32 | before[act]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            hit = act[by[np.append(same, False) | np.append(False, same)]]
            least[hit] = np.minimum(least[hit], o)
            most[hit] = np.maximum(most[hit], o)
        self.least[number], self.most[number] = least, most


def matches(heads: np.ndarray, datas: list[bytes], length: int, batch: int = BATCH) -> np.ndarray:
    """The repeated offsets of entries, as _COVER records of those that have any, with the place of each in `heads`: one family over all of them."""
    family = Family(length, heads["least"].astype(np.int64), heads["left"].astype(np.int64), heads["many"] > 0)
    rows: list = []
    number = at = 0
    for data in datas:
        at = 0
        while at < len(data):
            left, size = int(heads["left"][number]), int(heads["size"][number])
            rows.append((data[at + left : at + size], data[at : at + left][::-1], number))
            at += size
            number += 1
            if len(rows) >= batch:
                family.add(rows)
                rows = []
    if rows:
        family.add(rows)
    family.close()
    hit = np.flatnonzero(family.most >= family.least)
    out = np.zeros(len(hit), [("place", "<i8"), *_COVER.descr])
    out["place"], out["fp"], out["least"], out["most"] = hit, heads["fp"][hit], family.least[hit], family.most[hit]
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else.

    Takes doc_id and text; other columns are ignored, whatever their names.  Texts are their UTF-8 bytes and matches
    never cross documents.  Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans
    (start and end of each run in bytes, end exclusive, flattened) and kept (the remaining bytes; a cut may fall inside
    a character; null without `with_text`).
    Null or empty text, and texts under `length` bytes: nothing removed.  Repeated rows are documents of their own and
    so repeat each other; rows equal in both doc_id and text meet in one chunk.  Null doc_id is allowed.  An empty
    table gives an empty table.  `length` is 2 at least and 60,000 at most.
    """
    if not 2 <= length <= 60_000:
        raise ValueError("length")
    total = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    n_chunks = max(LEAST, -(-total // CHUNK_BYTES))
    n_buckets = max(LEAST, -(-total // BUCKET_BYTES))
    shift = np.float64(n_buckets) / np.float64(2**64)

    d = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def bucket(hashes):
        return np.minimum((hashes.astype(np.float64) * shift).astype(np.int64), n_buckets - 1)

    def send(key, tab):
        grams, prints = [], []
        for _, _, x in _all(kern.column(tab, "text"), length):
            grams.append(x.gram)
            prints.append(x.fp)
        gram = _join(grams)
        _, where = np.unique(_join(prints), return_index=True)
        once, many = _split(gram)
        u, n = np.unique(gram[where], return_counts=True)
        counts = n[np.searchsorted(u, many)].astype("<u4")
        cut = [bucket(x) for x in (once, many)]
        full = np.union1d(*cut)
        (a, c), (b, e) = ([np.searchsorted(x, full, side).tolist() for x in cut] for side in ("left", "right"))
        return kern.table(_GRAMS, bucket=full, chunk=[key[0].as_py()] * len(full), once=[kern.pack(once[i:j]) for i, j in zip(a, b)], many=[kern.pack(many[i:j]) for i, j in zip(c, e)], counts=[counts[i:j].tobytes() for i, j in zip(c, e)])

    def count(key, tab):
        chunk = kern.column(tab, "chunk")
        once, many = ([kern.unpack(x) for x in kern.column(tab, c)] for c in ("once", "many"))
        counts = [np.frombuffer(x, "<u4") for x in kern.column(tab, "counts")]
        seen = np.concatenate([*once, *many])
        u, back = np.unique(seen, return_inverse=True)
        n = np.bincount(back, minlength=len(u))
        distinct = np.bincount(back, weights=np.concatenate([np.ones(sum(map(len, once))), *counts]), minlength=len(u))
        twice = np.union1d(u[n > 1], _join(many))
        large = u[distinct > hot]
        met = [x[kern.member(x, twice)] for x in once]
        big = [np.sort(np.concatenate([x[kern.member(x, large)], y[kern.member(y, large)]])) for x, y in zip(once, many)]
        rows = [i for i in range(len(chunk)) if len(met[i]) or len(big[i])]
        return kern.table(_MET, chunk=[chunk[i] for i in rows], grams=[kern.pack(met[i]) for i in rows], hot=[kern.pack(big[i]) for i in rows])

    def cut(key, tab, met):
        grams, large = (np.unique(_join(kern.unpack(x) for x in kern.column(met, c))) for c in ("grams", "hot"))
        texts = kern.column(tab, "text")
        _, many = _split(_join(x.gram for _, _, x in _all(texts, length)))
        grams = np.union1d(grams, many)
        heads, datas, hashes = [], [], []
        for _, _, x in _all(texts, length) if len(grams) or len(large) else ():
            big = kern.member(x.gram, large)
            which = np.flatnonzero(kern.member(x.gram, grams) & ~big)
            hashes.append(x.windows(np.flatnonzero(big))[1])
            head = np.zeros(len(which), _HEAD)
            head["fp"], head["gram"], head["left"], head["least"] = x.fp[which], x.gram[which], (x.at - x.first)[which], (x.at - x.last)[which]
            head["size"] = (x.last - x.first)[which] + length
            raw = x.buf.tobytes()
            heads.append(head)
            datas += [raw[a:b] for a, b in zip(x.first[which].tolist(), (x.last[which] + length).tolist())]
        head = np.concatenate(heads) if heads else np.zeros(0, _HEAD)
        _, where, n = np.unique(head["fp"], return_index=True, return_counts=True)
        head = head[where]
        head["many"] = n > 1
        by = np.argsort(head["gram"], kind="stable")
        head, where = head[by], where[by]
        once, twice = _split(_join(hashes))
        cuts = [bucket(x) for x in (head["gram"], once, twice)]
        full = np.unique(np.concatenate(cuts))
        spans = [list(zip(np.searchsorted(c, full, "left").tolist(), np.searchsorted(c, full, "right").tolist())) for c in cuts]
        return kern.table(
            _SENT, bucket=full, chunk=[key[0].as_py()] * len(full), heads=[head[a:b].tobytes() for a, b in spans[0]], data=[b"".join(datas[i] for i in where[a:b]) for a, b in spans[0]],
            once=[kern.pack(once[a:b]) for a, b in spans[1]], many=[kern.pack(twice[a:b]) for a, b in spans[2]],
        )

    def search(key, tab):
        chunk = np.array(kern.column(tab, "chunk"))
        heads = [np.frombuffer(x, _HEAD) for x in kern.column(tab, "heads")]
        owner = np.repeat(np.arange(len(chunk)), [len(x) for x in heads])
        found = matches(np.concatenate(heads), kern.column(tab, "data"), length)
        whose = owner[found["place"]]
        cover = np.zeros(len(found), _COVER)
        for c in _COVER.names:
            cover[c] = found[c]
        once, many = ([kern.unpack(x) for x in kern.column(tab, c)] for c in ("once", "many"))
        u, n = np.unique(np.concatenate([*once, *many]), return_counts=True)
        twice = np.union1d(u[n > 1], _join(many))
        windows = [x[kern.member(x, twice)] for x in once]
        rows = [i for i in range(len(chunk)) if len(windows[i]) or (whose == i).any()]
        return kern.table(_FOUND, chunk=chunk[rows], cover=[cover[whose == i].tobytes() for i in rows], windows=[kern.pack(windows[i]) for i in rows], hot=[b""] * len(rows))

    def strip(key, tab, found):
        ids, texts = kern.column(tab, "doc_id"), kern.column(tab, "text")
        cover = np.concatenate([np.zeros(0, _COVER), *(np.frombuffer(x, _COVER) for x in kern.column(found, "cover") if x)])
        cover = cover[np.argsort(cover["fp"], kind="stable")]
        large = np.unique(_join(kern.unpack(x) for x in kern.column(found, "hot") if x))
        twice = _join(kern.unpack(x) for x in kern.column(found, "windows") if x)
        if len(large):
            _, many = _split(_join(x.windows(np.flatnonzero(kern.member(x.gram, large)))[1] for _, _, x in _all(texts, length)))
            twice = np.union1d(twice, many)
        out = {n: [] for n in _OUT.names}
        some = len(cover) or len(twice)
        for lo, hi, x in _all(texts, length) if some else ((lo, hi, None) for lo, hi in kern.blocks(texts)):
            gone = None
            if x is not None:
                delta = np.zeros(len(x.buf) + 1, np.int32)
                if len(cover):
                    where = np.minimum(np.searchsorted(cover["fp"], x.fp), len(cover) - 1)
                    hit = np.flatnonzero(cover["fp"][where] == x.fp)
                    c = cover[where[hit]]
                    np.add.at(delta, x.at[hit] - c["most"], 1)
                    np.add.at(delta, x.at[hit] - c["least"] + length, -1)
                if len(twice):
                    at, h = x.windows(np.flatnonzero(kern.member(x.gram, large)))
                    at = at[kern.member(h, twice)]
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + length, -1)
                gone = np.cumsum(delta[:-1]) > 0
            for i in range(lo, hi):
                text, spans = texts[i] or b"", []
                if gone is not None:
                    a = x.start[i - lo]
                    spans = np.flatnonzero(np.diff(gone[a : a + len(text)].view(np.int8), prepend=0, append=0)).tolist()
                edges = [0, *spans, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["doc_id"].append(ids[i])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(spans) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append(spans)
                out["kept"].append(kept if with_text else None)
        return kern.table(_OUT, **out)

    chunks = d.groupBy("chunk")
    met = chunks.applyInArrow(send, "bucket int, chunk int, once binary, many binary, counts binary").groupBy("bucket").applyInArrow(count, "chunk int, grams binary, hot binary")
    sent = chunks.cogroup(met.groupBy("chunk")).applyInArrow(cut, "bucket int, chunk int, heads binary, data binary, once binary, many binary")
    found = sent.groupBy("bucket").applyInArrow(search, "chunk int, cover binary, windows binary, hot binary")
    large = met.where(F.octet_length("hot") > 0).select("chunk", F.lit(b"").alias("cover"), F.lit(b"").alias("windows"), "hot")
    return chunks.cogroup(found.unionByName(large).groupBy("chunk")).applyInArrow(strip, _OUT_SQL)
