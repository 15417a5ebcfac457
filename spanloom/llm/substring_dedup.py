"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Documents are dealt into chunks by a hash of doc_id and text, so that neither a null or
   repeated id nor a text with many copies fills one chunk.
2. Each chunk hashes every window of `window` words with a rolling polynomial
   hash modulo 2**64 and sends each distinct hash once to a bucket of the hash
   space, in sorted packed blobs, with those it saw twice apart.  However common
   a passage is, a bucket gets its hash once from a chunk.
3. A bucket counts its hashes over all chunks and answers each chunk with those
   found more than once.
4. Chunks meet their answers; repeated windows merge into maximal removal
   intervals of words, and the other words are kept.

Only texts, hashes and answers move, each once; nothing is collected.  Two
different windows share a 64-bit hash with probability n**2 / 2**65 over n
windows: 5e-4 at 140 million.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern

#: Words in a window, as in the published exact-substring filters' 50 tokens, set by the query.
WINDOW = 35
CHUNK_BYTES, BUCKET_BYTES, LEAST = 4 << 20, 8 << 20, 48
#: Chunks and buckets grow by one for each so many bytes of text, up to so many times: a chunk's blob for a bucket keeps hundreds of hashes at 1 TB.
GROW_BYTES, MOST_GROWTH = 64 << 30, 8

_FP = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("many", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("hashes", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.string())])
_OUT_SQL = "doc_id long, n_words long, n_removed long, intervals array<long>, kept_sha256 string, kept string"


def _windows(texts, k):
    """For each block: documents lo..hi, their words, window hashes and where each window starts."""
    for lo, hi in kern.blocks(texts):
        w = kern.Words(texts[lo:hi])
        h, at = w.windows(w.hashes(), k)
        yield lo, w, h, at


def _count(texts, k):
    parts = [h for _, _, h, _ in _windows(texts, k)]
    u, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    return u[n == 1], u[n > 1]


def _kept(w: kern.Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of kept words, each followed by a space, and where each document's begin."""
    keep = ~removed
    s, e = w.start[keep], w.end[keep]
    delta = np.zeros(len(w.buf) + 2, np.int8)
    delta[s] += 1
    delta[e + 1] -= 1
    data = np.append(w.buf, np.uint8(0x20))
    data[w.end] = 0x20
    out = data[np.cumsum(delta[: len(data)], dtype=np.int8) > 0]
    size = np.zeros(len(keep), np.int64)
    size[keep] = e - s + 1
    return out, np.concatenate([[0], np.cumsum(kern.per_doc(w, size))])


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of `window` words whose word sequence also starts elsewhere.

    Takes doc_id and text; other columns are ignored, whatever their names.
    Returns doc_id, n_words, n_removed, intervals (start and end of each maximal
    removed run of words, end exclusive, flattened), kept_sha256 and kept (the
    remaining words joined by one space; null without `with_text`).
    Null or empty text: no words, the hash of the empty string.  Repeated rows are
    documents of their own and so repeat each other.  Null doc_id is allowed.
    An empty table gives an empty table.
    """
    total = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    growth = min(MOST_GROWTH, 1 + total // GROW_BYTES)
    n_chunks = max(LEAST, -(-total // (CHUNK_BYTES * growth)))
    n_buckets = max(LEAST, -(-total // (BUCKET_BYTES * growth)))
    shift = np.float64(n_buckets) / np.float64(2**64)

    d = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )

    def send(key, tab):
        once, many = _count(kern.column(tab, "text"), window)
        cut = [np.minimum((x.astype(np.float64) * shift).astype(np.int64), n_buckets - 1) for x in (once, many)]
        full = np.union1d(*cut)  # only buckets that get something
        lo, hi = ([np.searchsorted(c, full, side).tolist() for c in cut] for side in ("left", "right"))
        once, many = ([kern.pack(x[a:b]) for a, b in zip(p, q)] for x, p, q in zip((once, many), lo, hi))
        return kern.table(_FP, bucket=full, chunk=[key[0].as_py()] * len(full), once=once, many=many)

    def count(key, tab):
        chunk, once, many = (kern.column(tab, c) for c in ("chunk", "once", "many"))
        once, many = [kern.unpack(x) for x in once], [kern.unpack(x) for x in many]
        seen = np.sort(np.concatenate([*once, *many]))
        twice = seen[1:][seen[1:] == seen[:-1]]
        twice = np.unique(np.concatenate([twice, *many]))
        found = [x[kern.member(x, twice)] for x in once]
        return kern.table(_ANSWER, chunk=[c for c, x in zip(chunk, found) if len(x)], hashes=[kern.pack(x) for x in found if len(x)])

    def strip(key, tab, answers):
        ids, texts = kern.column(tab, "doc_id"), kern.column(tab, "text")
        _, many = _count(texts, window)
        twice = np.unique(np.concatenate([many, *(kern.unpack(x) for x in kern.column(answers, "hashes"))]))
        out = {n: [] for n in _OUT.names}
        for lo, w, h, at in _windows(texts, window):
            removed = kern.covered(len(w.start), at[kern.member(h, twice)], window)
            data, cut = _kept(w, removed)
            out["doc_id"] += ids[lo : lo + len(w.count)]
            out["n_words"] += w.count.tolist()
            out["n_removed"] += kern.per_doc(w, removed).tolist()
            for i in range(len(w.count)):
                kept = data[cut[i] : max(cut[i], cut[i + 1] - 1)].tobytes()
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "replace") if with_text else None)
                r = removed[w.bounds[i] : w.bounds[i + 1]].view(np.int8)
                out["intervals"].append(np.flatnonzero(np.diff(r, prepend=0, append=0)).tolist())
        return kern.table(_OUT, **out)

    sent = d.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, once binary, many binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "chunk int, hashes binary")
    return d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(strip, _OUT_SQL)
