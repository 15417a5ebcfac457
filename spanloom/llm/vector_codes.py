"""Vector code compression by heap Lloyd: product codes whose codebooks come from exact integer Lloyd rounds.

A component x is the integer floor(1024 x).  Vectors are cut into four parts, and each part position has a codebook of at
most 256 entries, so all codebooks hold 256 integers a component: they are what the driver and every task hold.

Rows are packed in blocks that live in a written table.  For each part position and entry a block keeps a heap of the
parts that the entry holds, keyed by the slack of their bounds: the distance to the second-nearest entry less that to
their own, plus the drift the entry had gathered when they were pushed.  An entry's drift grows in a round by its own
move and the largest move of all: while a key stays above it, no other entry can have come as near, so only the parts at
the top of a heap are popped and measured again against the whole codebook; what is below has the same entry as before.
A round writes the blocks anew, with what the parts that changed entry add to and take from its sums; the sums are added
up by Spark and only they reach the driver.  Parts that tie always measure again, so ties go to the lower index; keys
are lowered by more than the rounding of their square roots.

A lost executor costs its tasks: each round starts from a written table, and the one before is then deleted.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import kern, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bytes of packed components in a block, and the most labels whose sums are broadcast (joined otherwise).
BLOCK_BYTES, MOST_LABELS = 1 << 20, 100_000
#: Part vectors measured against a codebook at once.
MEASURE = 4096


def bound(width: int) -> int:
    """The largest component whose squared distances are exact in doubles; larger ones count as this."""
    return min((1 << 31) - 1, math.isqrt((1 << 53) // (4 * max(1, width)) - 1))


def measure(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x its nearest entry (ties: lowest), and the distances to that and to the second-nearest, in exact squares before the roots."""
    entry, near, next_ = np.zeros(len(x), np.uint8), np.zeros(len(x)), np.full(len(x), np.inf)
    b = book.astype(np.float64)
    bb = (b * b).sum(axis=1)
    for i in range(0, len(x), MEASURE):
        a = x[i : i + MEASURE].astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] + bb - 2.0 * (a @ b.T)
        k = d.argmin(axis=1)
        row = np.arange(len(a))
        entry[i : i + MEASURE], near[i : i + MEASURE] = k, np.sqrt(d[row, k])
        if len(b) > 1:
            d[row, k] = np.inf
            next_[i : i + MEASURE] = np.sqrt(d.min(axis=1))
    return entry, near, next_


class Heaps:
    """One part position's heaps of a block: sizes by entry, and all keys and rows, entry after entry in heap order."""

    def __init__(self, size: np.ndarray, key: np.ndarray, row: np.ndarray):
        self.size, self.key, self.row = size, key, row
        self.at = np.concatenate([[0], np.cumsum(size)])

    def heap(self, entry: int) -> list[tuple[float, int]]:
        a, b = self.at[entry], self.at[entry + 1]
        return list(zip(self.key[a:b].tolist(), self.row[a:b].tolist()))

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Entries with a top key that the drift has reached."""
        full = np.flatnonzero(self.size)
        return full[self.key[self.at[full]] <= drift[full]]

    def replaced(self, new: dict[int, list[tuple[float, int]]]) -> Heaps:
        """These heaps with some put in place of others."""
        key, row, size = [], [], self.size.copy()
        done = 0
        for e in sorted(new):
            key += [self.key[self.at[done] : self.at[e]], np.array([k for k, _ in new[e]], np.float64)]
            row += [self.row[self.at[done] : self.at[e]], np.array([r for _, r in new[e]], np.int32)]
            size[e], done = len(new[e]), e + 1
        key.append(self.key[self.at[done] :])
        row.append(self.row[self.at[done] :])
        return Heaps(size, np.concatenate(key), np.concatenate(row))


def reassign(x: np.ndarray, entry: np.ndarray, heaps: Heaps, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, Heaps]:
    """Pop what the drift has reached and measure it again; returns the rows popped, their entries before (in `entry`: now), and the heaps."""
    changed: dict[int, list[tuple[float, int]]] = {}
    popped: list[int] = []
    for e in heaps.violated(drift).tolist():
        heap = changed[e] = heaps.heap(e)
        most = drift[e]
        while heap and heap[0][0] <= most:
            popped.append(heapq.heappop(heap)[1])
    rows = np.array(popped, np.int64)
    before = entry[rows]
    if len(rows):
        now, near, next_ = measure(x[rows], book)
        entry[rows] = now
        slack = next_ - near - 1e-9 * (1 + near + np.where(np.isinf(next_), 0, next_)) + drift[now]
        for e, item in zip(now.tolist(), zip(slack.tolist(), popped)):
            if e not in changed:
                changed[e] = heaps.heap(e)
            heapq.heappush(changed[e], item)
    return rows, before, heaps.replaced(changed) if changed else heaps


def _sums(x: np.ndarray, rows: np.ndarray, before: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """Counts and component sums that the rows add to their entries and take from those they had."""
    out = np.zeros((ENTRIES, x.shape[1] + 1), np.int64)
    add = np.concatenate([np.ones((len(rows), 1), np.int64), x[rows].astype(np.int64)], axis=1)
    np.add.at(out, now, add)
    if before is not None:
        np.subtract.at(out, before, add)
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes and errors of all vectors.

    Returns vec_id, code (two hex digits a part), error (squared distance to the code's entries), label_error (the sum of
    error over equal labels) and codebooks_sha256; other columns are ignored, whatever their names.  Rows whose vector is
    null or holds a null or non-finite component are left out.  Shorter vectors count as padded by zeros to the longest
    one's length, and that to a multiple of four.  Components beyond `bound` (millions of steps) count as the bound.  Null
    ids come last among the first entries, equal ids in the order of their vectors; repeated rows are vectors of their
    own.  Under 256 rows make codebooks of as many entries.  Null labels are one label.  An empty table gives an empty
    table.
    """
    spark = vectors.sparkSession
    c = {n: kern.cols([n])[0] for n in (id_col, vector_col, label_col)}
    v = c[vector_col]
    kept = vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    kept = kept.select(c[id_col].cast("long").alias("vec_id"), v.alias("v"), c[label_col].alias("label"))
    width = -(-(kept.select(F.max(F.size("v"))).first()[0] or 0) // PARTS)
    most = bound(width)
    kind = np.dtype("<i2") if most < 1 << 15 else np.dtype("<i4")
    label = kept.schema["label"].dataType
    final = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    fields = [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), *(T.StructField(n, T.BinaryType()) for n in ("v", "entry", "size", "key", "row", "delta"))]
    state = T.StructType(fields)

    def whole(lists: pa.ListArray) -> np.ndarray:
        """Vectors of one Arrow batch as integer rows (n, PARTS * width)."""
        n = np.diff(lists.offsets.to_numpy())
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        out = np.zeros((len(n), PARTS * width), kind)
        out[np.arange(PARTS * width) < n[:, None]] = np.clip(flat, -most, most)
        return out

    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow()
    books = whole(seeds.column(0).combine_chunks()).astype(np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2) if seeds.num_rows else np.zeros((PARTS, 0, width), np.int64)
    k = books.shape[1]

    def digest(b: np.ndarray) -> str:
        return hashlib.sha256(",".join(map(str, b.reshape(-1).tolist())).encode()).hexdigest()

    if not k:
        empty = spark.createDataFrame([], final).withColumn("label_error", F.lit(0).cast("long")).withColumn("codebooks_sha256", F.lit(""))
        return empty.select("vec_id", "code", "error", "label_error", "codebooks_sha256")

    def block(ids, labels, x, entry, heaps, delta) -> pa.RecordBatch:
        held = np.flatnonzero(delta.reshape(PARTS * ENTRIES, -1).any(axis=1))
        moved = np.concatenate([held[:, None], delta.reshape(PARTS * ENTRIES, -1)[held]], axis=1)
        values = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels),
            *(pa.array([b], pa.binary()) for b in (x.tobytes(), entry.tobytes(), *(np.concatenate([getattr(h, n) for h in heaps]).tobytes() for n in ("size", "key", "row")), moved.astype("<i8").tobytes())),
        ]
        return pa.RecordBatch.from_arrays(values, names=state.names)

    def opened(batch, i):
        """Row i of a batch of blocks."""
        b = {n: batch.column(j)[i].as_py() for j, n in enumerate(state.names) if j > 1}
        ids, labels = (batch.column(j)[i].values for j in (0, 1))
        x = np.frombuffer(b["v"], kind).reshape(len(ids), PARTS, width)
        entry = np.frombuffer(b["entry"], np.uint8).reshape(PARTS, -1).copy()
        size = np.frombuffer(b["size"], np.int64).reshape(PARTS, ENTRIES)
        cut = np.concatenate([[0], np.cumsum(size.sum(axis=1))])
        key, row = np.frombuffer(b["key"], np.float64), np.frombuffer(b["row"], np.int32)
        return ids, labels, x, entry, [Heaps(size[p], key[cut[p] : cut[p + 1]], row[cut[p] : cut[p + 1]]) for p in range(PARTS)]

    def packed(sent):
        """Blocks of the input, every part measured once."""
        rows = max(64, BLOCK_BYTES // max(1, PARTS * width * kind.itemsize))

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    x = whole(part.column(1)).reshape(-1, PARTS, width)
                    entry, heaps, delta = np.zeros((PARTS, len(x)), np.uint8), [], []
                    for p in range(PARTS):
                        all_ = Heaps(np.bincount(np.zeros(len(x), np.int64), minlength=ENTRIES), np.full(len(x), -np.inf), np.arange(len(x), dtype=np.int32))
                        moved, _, h = reassign(x[:, p], entry[p], all_, sent.value[0][p], np.zeros(ENTRIES))
                        heaps.append(h)
                        delta.append(_sums(x[:, p], moved, None, entry[p][moved]))
                    yield block(part.column(0), part.column(2), x, entry, heaps, np.stack(delta))

        return run

    def again(sent, last):
        def run(batches):
            book, drift = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, x, entry, heaps = opened(batch, i)
                    delta = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
                    for p in range(PARTS):
                        rows, before, heaps[p] = reassign(x[:, p], entry[p], heaps[p], book[p], drift[p])
                        if not last:
                            delta[p] = _sums(x[:, p], rows, before, entry[p][rows])
                    if not last:
                        yield block(ids, labels, x, entry, heaps, delta)
                        continue
                    error = sum(((x[:, p].astype(np.int64) - book[p][entry[p]]) ** 2).sum(axis=1) for p in range(PARTS))
                    code = np.ascontiguousarray(entry.T).tobytes().hex()
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array([code[j : j + 2 * PARTS] for j in range(0, len(code), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())], names=final.names)

        return run

    def added(batches):
        """Sums of all blocks of a partition, by place."""
        total = np.zeros((PARTS * ENTRIES, width + 1), np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                m = np.frombuffer(blob, "<i8").reshape(-1, width + 2)
                total[m[:, 0]] += m[:, 1:]
        at = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.reshape(-1)[at], pa.int64())], names=["at", "value"])

    sums = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
    drift = np.zeros((PARTS, ENTRIES))
    table = None
    for r in range(ROUNDS + 1):
        sent = spark.sparkContext.broadcast((books, drift.copy()))
        step = kept.mapInArrow(packed(sent), state) if table is None else table.mapInArrow(again(sent, r == ROUNDS), state if r < ROUNDS else final)
        new = scratch.stored(step, f"codes-{r}")
        if table is not None:
            scratch.drop(spark, table._spanloom_path)
        table = new
        if r == ROUNDS:
            break
        got = table.select("delta").mapInArrow(added, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        np.add.at(sums.reshape(-1), got.column(0).to_numpy(), got.column(1).to_numpy())
        n = sums[:, :k, 0]
        old, books = books, books.copy()
        books[n > 0] = sums[:, :k, 1:][n > 0] // n[n > 0][:, None]
        move = np.sqrt(((books - old).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        drift[:, :k] += move + move.max(axis=1, keepdims=True)
    by_label = scratch.stored(table.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    few = by_label.count() <= MOST_LABELS
    out = table.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
