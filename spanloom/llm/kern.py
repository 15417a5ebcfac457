"""Byte-level numpy kernels shared by the text operators.

A batch of documents is one byte buffer: the UTF-8 texts joined by a newline,
so a word never spans two documents.  Words are maximal runs of bytes other
than space and 0x09-0x0D; those separators are ASCII, so this equals splitting
by code points.  Work arrays are built over slices of the buffer, so memory
stays near one slice however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)
_WBASE = np.uint64(0xD6E8FEB86659FD93 | 1)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd, so it has an inverse)."""
    have = _POW.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 4096)
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inv))
        _POW[int(base)] = have
    return have


def blocks(texts: list[bytes | None], limit: int = BLOCK):
    """Runs (lo, hi) of documents of about `limit` bytes; one longer document makes a run alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(texts) > lo:
        yield lo, len(texts)


class Words:
    """The words of a block of documents: byte spans, hashes and the document of each."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        texts = [t or b"" for t in texts]
        raw = b"\n".join(texts)
        self.raw = raw.lower() if lower else raw  # bytes.lower changes A-Z only
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        np.logical_not(_SEP[self.buf], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.doc_start)
        self.bounds = np.concatenate([self.first, [len(self.start)]])
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.buf, self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of every k-word window inside one document, and the index of its first word."""
        return windows(self.doc, hashes, k)


def windows(doc: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of k tokens of one document, and the index of its first token."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.empty(n, np.uint64)
    step = BLOCK
    pw, inv = _powers(_WBASE, min(n, step) + k)
    for a in range(0, n, step):
        b = min(n, a + step)
        part = hashes[a : b + k - 1]
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * pw[: len(part)], out=acc[1:])
        out[a:b] = mix((acc[k:] - acc[:-k]) * inv[: b - a])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return out[at], at


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending, disjoint byte spans, slice by slice."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + BLOCK, side="right")))
        hi = end[j - 1]
        pw, inv = _powers(_BASE, int(hi - lo))
        acc = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * pw[: hi - lo], out=acc[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        h = (acc[e] - acc[s]) * inv[s]
        out[i:j] = mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        i = j
    return out


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a k-word window that starts at one of `at`."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + k, n), -1)
    return np.cumsum(delta[:n]) > 0


def per_doc(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of a per-word value by document."""
    acc = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return acc[words.bounds[1:]] - acc[words.bounds[:-1]]


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending 64-bit values as deltas in byte planes; the high planes are zeros, which the shuffle's codec removes."""
    delta = np.diff(sorted_hashes, prepend=np.uint64(0))
    return delta.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def column(batch, name: str) -> list:
    """A column of an Arrow batch as Python values; binary text stays bytes."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def trim(buf: np.ndarray, start: np.ndarray, end: np.ndarray, chars: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spans less the given ASCII bytes at either end; a span of nothing else becomes empty."""
    odd = np.zeros(256, bool)
    odd[list(chars)] = True
    flag = odd[buf]
    start, end = start.copy(), end.copy()
    for at, move, edge in ((end, -1, -1), (start, 1, 0)):
        live = np.flatnonzero(end > start)
        while len(live):
            live = live[flag[at[live] + edge]]
            at[live] += move
            live = live[end[live] > start[live]]
    return start, end


def fresh(taken, stem: str) -> str:
    """A column name that is not taken, in any case."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


def cols(names) -> list:
    """Columns by their exact names, dots and backticks included."""
    from pyspark.sql import functions as F

    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def lower_part(share: float, *columns):
    """Whether the 64-bit hash of the columns lies in the lower `share` of its range: a sample that no size of a table empties."""
    from pyspark.sql import functions as F

    return F.xxhash64(*columns) <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))


def sampled(df, by: str, most: dict, *columns):
    """At most most[v] rows of each value v of `by`, exactly, whatever repeats: the least by a hash of the columns.

    Rows are thinned by the same hash to about twice that first, so that only those are sorted.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    if not most:
        return df.limit(0)
    have = {r[0]: r[1] for r in df.where(F.col(by).isin(list(most))).groupBy(by).agg(F.count(F.lit(1))).collect()}
    if not have:
        return df.limit(0)
    wide = F.create_map(*[F.lit(x) for v, n in have.items() for x in (v, min((1 << 63) - 1, int(min(1.0, (2 * most[v] + 1000) / n) * 2.0**64) - (1 << 63)))])
    top = F.create_map(*[F.lit(x) for v in have for x in (v, most[v])])
    draw = F.xxhash64(*columns)
    thin = df.where(draw <= F.try_element_at(wide, F.col(by))).withColumn("_draw", draw)
    place = F.row_number().over(W.partitionBy(by).orderBy("_draw", *[c for c in columns if isinstance(c, str)]))
    largest = max(most.values())
    return thin.withColumn("_place", place).where(F.col("_place") <= largest).where(F.col("_place") <= F.try_element_at(top, F.col(by))).drop("_draw", "_place")


def text_blocks(column, limit: int):
    """Runs (lo, hi, texts as bytes) of about `limit` bytes of an Arrow column of texts; only one run at a time becomes Python values."""
    raw = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, n = 0, len(ends)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi, raw.slice(lo, hi - lo).to_pylist()
        lo = hi


def map_text(df, fn, schema: str, arrow_schema: pa.Schema, extra: tuple[str, ...] = (), limit: int = BLOCK):
    """Apply fn(block of dicts of lists) -> dict of columns to (doc_id, text as bytes, *extra), a block at a time."""
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_blocks(batch.column(1), limit):
                block = {"doc_id": batch.column(0).slice(lo, hi - lo).to_pylist(), "text": texts}
                out = fn(block | {n: batch.column(2 + i).slice(lo, hi - lo).to_pylist() for i, n in enumerate(extra)})
                if out is not None:
                    yield from table(arrow_schema, **out).to_batches()
            pa.default_memory_pool().release_unused()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *extra).mapInArrow(run, schema)


def keep_by_text(df, fn, limit: int = BLOCK):
    """The rows of df, all columns, for whose texts fn(list of bytes or None) -> array of booleans is true."""
    from pyspark.sql import types as T

    # mapInArrow takes no names with dots
    held = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(df.schema.fields)])

    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [fn(texts) for _, _, texts in text_blocks(batch.column(at), limit)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))
            pa.default_memory_pool().release_unused()

    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols(df.columns))]).mapInArrow(run, held).toDF(*df.columns)
