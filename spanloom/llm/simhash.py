"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are sorted into tiles by the population counts of their
blocks of bits.  The Hamming distance of two fingerprints is at least the sum of
the differences of these counts, so tile pairs beyond the radius are skipped;
all others are compared whole, with numpy exclusive-or and bit counts.  A tile
pair yields a spanning forest of its links, not the links themselves, and
components of these forests are found by alternating min-label steps in Spark,
each cut off in the shared folder.

With `min_ratio` (fingerprints of shingle sets, for similarity joins) tiles are
also cut by the number of shingles: two sets of Jaccard similarity s have sizes
within a factor s of each other.  Fingerprints give candidates only there: inside
each component of candidates the shingle sets themselves are compared, and only
pairs whose Jaccard similarity reaches the threshold link.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern, scratch

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a sub-tile of the size-cut tiles, at least and at most; in between, a TILES-th of all, so that a fingerprint is copied to about as many jobs at any size.
TILE, MOST_TILE, TILES = 2048, 1 << 15, 128
#: Bytes of blobs that a task deals out at once.
DEAL = 4 << 20
#: Shingle sets in a block of the exact comparison.
SETS = 512


def _shingles(w: kern.Words, text: bytes, doc: int, k: int) -> list[bytes]:
    words = [text[a:b] for a, b in zip(w.start[w.bounds[doc] : w.bounds[doc + 1]], w.end[w.bounds[doc] : w.bounds[doc + 1]])]
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def _normal(w: kern.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each begins and ends."""
    delta = np.zeros(len(w.buf) + 2, np.int8)
    delta[w.start] += 1
    delta[w.end + 1] -= 1
    data = np.append(w.buf, np.uint8(0x20))
    data[w.end] = 0x20
    size = w.end - w.start
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    return data[np.cumsum(delta[: len(data)], dtype=np.int8) > 0].tobytes(), start, start + size


def shingle_hashes(texts: list[bytes | None], shingle: int = SHINGLE, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each shingle of lower-cased words, and their number by document; `distinct`: each once a document, ascending."""
    w = kern.Words(texts, lower=True)
    data, start, end = _normal(w)
    view = memoryview(data)
    first, n = w.bounds[:-1], np.maximum(w.count - shingle + 1, np.minimum(w.count, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.repeat(first, n)
    last = np.minimum(at + shingle, np.repeat(w.bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist())), np.uint64, len(at))
    if distinct and len(h):
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[new], doc[new]
        n = np.bincount(doc, minlength=len(texts))
    return h, n


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE, lanes: int = 1, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(documents x lanes) 64-bit words of the SimHash, and the number of shingles.

    Lane 0 votes with XXH64 (seed 42) of each shingle of lower-cased words; further
    lanes with mixes of it.  A bit is 1 if set in over half the hashes.  `distinct`
    counts a shingle once a document.
    """
    h, n = shingle_hashes(texts, shingle, distinct)
    return _vote(h, n, lanes), n


def _vote(h: np.ndarray, n: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros((len(n), lanes), np.uint64)
    cut = np.concatenate([[0], np.cumsum(n)])
    step = 1 << 15
    for lane in range(lanes):
        x = h if lane == 0 else kern.mix(h + np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        votes = np.zeros((len(n), 64), np.int64)
        for a in range(0, len(x), step):
            b = min(len(x), a + step)
            bits = np.unpackbits(x[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            acc = np.zeros((b - a + 1, 64), np.int32)
            np.cumsum(bits, axis=0, out=acc[1:], dtype=np.int32)
            lo, hi = np.clip(cut[:-1], a, b) - a, np.clip(cut[1:], a, b) - a
            full = hi > lo
            votes[full] += acc[hi[full]] - acc[lo[full]]
        out[:, lane] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


# ---- tiles ---------------------------------------------------------------


def _counts(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of `parts` equal blocks of bits of lane 0."""
    width = 64 // parts
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fp[:, 0] >> np.uint64(i * width)) & mask) for i in range(parts)], axis=1).astype(np.int16)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius (some may repeat): such a pair has radius // lanes or less in one lane at least."""
    lanes = a.shape[1]
    out = []
    for lane in range(lanes):
        i, j = np.nonzero(np.bitwise_count(np.ascontiguousarray(a[:, lane])[:, None] ^ np.ascontiguousarray(b[:, lane])[None]) <= radius // lanes)
        if lanes > 1 and len(i):
            ok = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int32) <= radius
            i, j = i[ok], j[ok]
        out.append((i, j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


class _Forest:
    """Union-find over row numbers with whole-array steps."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            open_ = lo != hi
            if not open_.any():
                return
            i, j, lo, hi = i[open_], j[open_], lo[open_], hi[open_]
            np.minimum.at(self.label, hi, lo)
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def links(own: np.ndarray, others: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as (row, root row), of own x own and own x others; rows of others follow those of own."""
    both = np.concatenate([own, others]) if len(others) else own
    forest = _Forest(len(both))
    step = max(1, (1 << 22) // (own.shape[1] * max(1, len(both))))
    for a in range(0, len(own), step):
        i, j = _near(own[a : a + step], both[a:], radius)
        fresh = j > i
        forest.join(i[fresh] + a, j[fresh] + a)
    child = np.flatnonzero(forest.label != np.arange(len(both)))
    return list(zip(child.tolist(), forest.label[child].tolist()))


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _unblob(blobs: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, lanes)


def _edges(tab_fp: np.ndarray, found) -> pa.Table:
    return kern.table(_EDGE, a=[tab_fp[i].tobytes() for i, _ in found], b=[tab_fp[j].tobytes() for _, j in found])


def _neighbours(parts: int, radius: int) -> np.ndarray:
    """Offsets of count vectors within the radius (in sum of differences), the upper half and zero."""
    out = [np.zeros(parts, np.int16)]
    seen = {bytes(out[0])}
    at = 0
    while at < len(out):
        for p in range(parts):
            for s in (1, -1):
                v = out[at].copy()
                v[p] += s
                if np.abs(v).sum() <= radius and v.tobytes() not in seen:
                    seen.add(v.tobytes())
                    out.append(v)
        at += 1
    return np.array([v for v in out if not v.any() or v[np.flatnonzero(v)[0]] < 0])


def links_by_counts(fps: DataFrame, radius: int, parts: int) -> DataFrame:
    """Spanning links (a, b) between distinct one-lane fingerprints (binary column fp) within the radius.

    A tile sends its fingerprints, packed, to itself and to every tile below it that the counts allow.
    """
    offsets = _neighbours(parts, radius)
    top = 64 // parts

    def shed(batches):
        for batch in batches:
            fp = _unblob(batch.column(0).to_pylist(), 1)
            if not len(fp):
                continue
            key = _counts(fp, parts).astype(np.int8)
            order = np.lexsort(key.T[::-1])
            fp, key = fp[order], key[order]
            cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(fp))
            tiles, own, blobs = [], [], []
            for a, b in zip(cut[:-1], cut[1:]):
                to = key[a].astype(np.int16) + offsets
                to = to[((to >= 0) & (to <= top)).all(axis=1)].astype(np.int8)
                blob = fp[a:b].tobytes()
                tiles += [t.tobytes() for t in to]
                own += [bool((t == key[a]).all()) for t in to]
                blobs += [blob] * len(to)
            yield from pa.table({"tile": pa.array(tiles, pa.binary()), "own": pa.array(own, pa.bool_()), "fps": pa.array(blobs, pa.binary())}).to_batches()

    def compare(key, tab):
        own, blobs = kern.column(tab, "own"), kern.column(tab, "fps")
        a = _unblob([x for x, o in zip(blobs, own) if o], 1)
        if not len(a):
            return _EDGE.empty_table()
        b = _unblob([x for x, o in zip(blobs, own) if not o], 1)
        return _edges(np.concatenate([a, b]), links(a, b, radius))

    return fps.mapInArrow(shed, "tile binary, own boolean, fps binary").groupBy("tile").applyInArrow(compare, "a binary, b binary")


_JOB = pa.schema([("job", pa.string()), ("own", pa.bool_()), ("fps", pa.binary())])


def deal_by_size(batches, held: dict[int, int]):
    """Batches of (size class, sub-tile, fingerprints) to the jobs that compare them; held has the sub-tiles of each class.  One row's copies at a time, about DEAL bytes a batch."""
    for batch in batches:
        for r in range(batch.num_rows):
            size, s, blob = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), b"".join(batch.column(2)[r].as_py())
            jobs = [((size, i, size, s), i == s) for i in range(s + 1)] + [((size, s, size, j), True) for j in range(s + 1, held[size])]
            jobs += [((size, s, size + 1, j), True) for j in range(held.get(size + 1, 0))]
            jobs += [((size - 1, i, size, s), False) for i in range(held.get(size - 1, 0))]
            step = max(1, DEAL // max(1, len(blob)))
            for k in range(0, len(jobs), step):
                some = jobs[k : k + step]
                yield from kern.table(_JOB, job=[",".join(map(str, j)) for j, _ in some], own=[o for _, o in some], fps=[blob] * len(some)).to_batches()
        pa.default_memory_pool().release_unused()


def links_by_size(fps: DataFrame, radius: int, min_ratio: float, lanes: int) -> DataFrame:
    """Spanning links between distinct fingerprints (fp, n shingles) whose sizes are within min_ratio of each other.

    Tiles are size classes a factor 1/min_ratio wide, cut into sub-tiles of TILE to MOST_TILE
    fingerprints; a job compares two sub-tiles of the same or of adjacent classes.
    """
    classes = fps.select("fp", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / math.log(1 / min_ratio)).cast("int").alias("size"))
    sizes = {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}  # a row for each class: under 200 whatever the input
    tile = max(TILE, min(MOST_TILE, sum(sizes.values()) // TILES))
    held = {z: -(-n // tile) for z, n in sizes.items()}
    cut = F.create_map(*[F.lit(x) for kv in (held or {0: 1}).items() for x in kv])
    sub = F.pmod(F.xxhash64("fp"), F.try_element_at(cut, F.col("size")).cast("long")).cast("int")
    packed = classes.withColumn("sub", sub).groupBy("size", "sub", F.pmod(F.spark_partition_id(), F.lit(8)).alias("part")).agg(F.collect_list("fp").alias("l"))

    def compare(key, tab):
        own, blobs = kern.column(tab, "own"), kern.column(tab, "fps")
        a = _unblob([x for x, o in zip(blobs, own) if o], lanes)
        b = _unblob([x for x, o in zip(blobs, own) if not o], lanes)
        if not len(a):
            return _EDGE.empty_table()
        _, i, _, j = key[0].as_py().split(",")
        if len(b) and a is not b:
            forest = _Forest(len(a) + len(b))
            step = max(1, (1 << 22) // (lanes * len(b)))
            for x in range(0, len(a), step):
                p, q = _near(a[x : x + step], b, radius)
                forest.join(p + x, q + len(a))
            child = np.flatnonzero(forest.label != np.arange(len(a) + len(b)))
            return _edges(np.concatenate([a, b]), list(zip(child.tolist(), forest.label[child].tolist())))
        return _edges(a, links(a, b, radius))

    return packed.select("size", "sub", "l").mapInArrow(lambda batches: deal_by_size(batches, held), "job string, own boolean, fps binary").groupBy("job").applyInArrow(compare, "a binary, b binary")


# ---- exact sets ----------------------------------------------------------


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest (row, row) of all pairs whose exact Jaccard similarity is at least the given one.

    Breadth first: each set meets, by postings, those that nothing has reached yet.
    """
    n = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(n)])
    holder = np.repeat(np.arange(len(sets)), n)[np.argsort(token, kind="stable")]
    post = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=1))])
    fresh = np.ones(len(sets), bool)
    out = []
    for seed in range(len(sets)):
        queue = [seed] if fresh[seed] else []
        fresh[seed] = False
        while queue and fresh.any():
            i = queue.pop()
            t = token[cut[i] : cut[i + 1]]
            size = post[t + 1] - post[t]
            at = np.arange(size.sum()) + np.repeat(post[t] - (np.cumsum(size) - size), size)
            met = np.bincount(holder[at], minlength=len(sets))
            near = np.flatnonzero(fresh & (met + 1e-9 >= similarity * (n[i] + n - met)))
            fresh[near] = False
            out += [(j, i) for j in near.tolist()]
            queue += near.tolist()
    return out


def links_by_sets(docs: DataFrame, classes: DataFrame, near: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between ids of classes (id, at, fp, n) whose shingle sets have the Jaccard similarity or more.

    Candidates are the components of `near` (a, b), links between fingerprints.  One text stands for
    a class: docs has it at `_at`.  Small components are bundled; one of over SETS classes is cut into
    blocks by size of set, and a job compares two blocks of the same or of adjacent size classes.
    """
    roots = components(near, "near").withColumnRenamed("node", "fp")
    fps = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).join(roots, "fp", "left").where("root is not null or m > 1").select("fp", F.coalesce("root", "fp").alias("root"))
    # a little wider than 1 / similarity, so that no pair at the threshold is two classes apart
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / (1e-9 - math.log(similarity))).cast("int")
    cand = scratch.stored(classes.join(fps, "fp").select("id", F.col("at").alias("_at"), "root", band.alias("band")), "candidates")
    bundles = max(1, cand.count() // (2 * SETS))
    sizes = cand.groupBy("root", "band").count()
    large = sizes.groupBy("root").agg(F.sum("count").alias("m"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("count") / SETS).cast("int")))).alias("parts")).where(F.col("m") > SETS).drop("m")
    # a row for each SETS candidates at most
    cand = cand.join(F.broadcast(large), "root", "left").withColumn("bundle", F.pmod(F.xxhash64("root"), F.lit(bundles)).cast("string"))

    def packed(rows):
        cols = list(zip(*rows))
        return pa.table({"job": pa.array(cols[0], pa.string()), **{c: pa.array(x, pa.binary()) for c, x in zip(("root", "id", "blob"), cols[1:])}}).to_batches()

    def shed(batches):
        rows, size = [], 0
        for batch in batches:
            for lo, hi, text in kern.text_blocks(batch.column(0), kern.BLOCK):
                ids, root, bands, parts, bundle = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(1, 6))
                h, n = shingle_hashes(text, shingle, True)
                cut = np.concatenate([[0], np.cumsum(n)])
                for k in range(hi - lo):
                    blob = h[cut[k] : cut[k + 1]].tobytes()
                    if _digest(blob) != ids[k]:  # another text under the same key
                        continue
                    jobs = [bundle[k]]
                    if parts[k] is not None:
                        held, z = dict(parts[k]), bands[k]
                        own = int.from_bytes(ids[k][:4]) % held[z]
                        jobs = [(z, min(i, own), z, max(i, own)) for i in range(held[z])]
                        jobs += [(z, own, z + 1, j) for j in range(held.get(z + 1, 0))] + [(z - 1, i, z, own) for i in range(held.get(z - 1, 0))]
                        jobs = [root[k].hex() + "," + ",".join(map(str, j)) for j in jobs]
                    for j in jobs:
                        rows.append((j, root[k], ids[k], blob))
                        size += len(blob)
                        if size >= DEAL or len(rows) >= 1 << 14:
                            yield from packed(rows)
                            rows, size = [], 0
            pa.default_memory_pool().release_unused()
        if rows:
            yield from packed(rows)

    def compare(key, tab):
        groups = {}
        for root, i, blob in zip(kern.column(tab, "root"), kern.column(tab, "id"), kern.column(tab, "blob")):
            groups.setdefault(root, {})[i] = np.frombuffer(blob, np.uint64)
        found = [(ids[i], ids[j]) for ids, sets in ((list(g), list(g.values())) for g in groups.values()) for i, j in jaccard_forest(sets, similarity)]
        return kern.table(_EDGE, a=[x for x, _ in found], b=[x for _, x in found])

    texts = docs.select(F.col("text").cast("binary").alias("text"), "_at").join(cand, "_at").select("text", "id", "root", "band", "parts", "bundle")
    return texts.mapInArrow(shed, "job string, root binary, id binary, blob binary").groupBy("job").applyInArrow(compare, "a binary, b binary")


def _digest(blob: bytes) -> bytes:
    return hashlib.blake2b(blob, digest_size=16).digest()


# ---- components -----------------------------------------------------------


def components(edges: DataFrame, name: str = "cc", limit: int = 60) -> DataFrame:
    """(node, root) with the least node of each component as root, for nodes that have an edge.

    Every round each node takes the least label among itself and its neighbours and
    then that label's own label (pointer jumping), until nothing changes; rounds are
    about the logarithm of the longest path.  Each round is written to the shared folder, and
    deleted when the next one is.
    """
    with scratch.run():
        # written before it is turned round: a second run of the comparison may give another forest
        e = scratch.stored(edges.where(F.col("a") != F.col("b")).select("a", "b"), name)
        e = scratch.stored(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
        labels = scratch.stored(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), name)
        for _ in range(limit):
            up = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
            step = labels.join(up, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
            # hook: the old root learns the least label that any of its nodes has seen
            hook = step.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("h"))
            step = step.join(hook, "node", "left").select("node", F.least("root", F.coalesce("h", "root")).alias("root"), "was")
            step = scratch.stored(step, name)
            jump = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            new = scratch.stored(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was"), name)
            labels = new.select("node", "root")
            done = new.where(F.col("root") != F.col("was")).isEmpty()
            scratch.release(edges.sparkSession, new, *([] if done else [e]))
            if done:
                return labels
    raise RuntimeError("components did not settle")


# ---- operator ---------------------------------------------------------------

_FP = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("fp", pa.binary()), ("n", pa.int64()), ("id", pa.binary())])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, lanes: int = 1, distinct: bool = False, min_ratio: float | None = None) -> DataFrame:
    """doc_id, fp (bytes, each lane big-endian) and component_id (least doc_id linked, itself included) of every document.

    Null or empty text has fingerprint zero and links like any other.  Null doc_ids
    keep their row; a component of null doc_ids alone has a null component_id.  Repeated
    rows are documents with the same fingerprint.  An empty table gives an empty
    table.  Columns other than doc_id and text are ignored.  Very long texts are
    hashed whole, block by block.

    With `min_ratio` (and `distinct`) the radius only finds candidates: documents link if the Jaccard
    similarity of their sets of shingles, taken as 64-bit hashes, is at least min_ratio.
    """

    def run(block):
        h, n = shingle_hashes(block["text"], shingle, distinct)
        fp = [x.byteswap().tobytes() for x in _vote(h, n, lanes)]
        cut = np.concatenate([[0], np.cumsum(n)])
        ids = fp if min_ratio is None else [_digest(h[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        return {"doc_id": block["doc_id"], "at": block["_at"], "fp": fp, "n": n, "id": ids}

    # a null doc_id takes its text's hash as key, so that null keys do not all meet
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_at"))
    all_ = scratch.stored(kern.map_text(docs, run, "doc_id long, at long, fp binary, n long, id binary", _FP, ("_at",)), "fingerprints")
    classes = scratch.stored(all_.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least"), F.min("at").alias("at"), F.max("n").alias("n")), "classes")
    if min_ratio is None:
        n = classes.count()
        parts = 4 if n < 1 << 20 else 8 if n < 1 << 27 else 16
        edges = links_by_counts(classes.select("fp"), radius, parts)
    else:
        near = links_by_size(classes.select("fp", "n").distinct(), radius, min_ratio, lanes)
        edges = links_by_sets(docs, classes, near, shingle, min_ratio)
    roots = components(edges)
    joined = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    return all_.join(named, "id").select("doc_id", "fp", "component_id")


@lru_cache
def candidate_radius(similarity: float, bits: int) -> int:
    """Three deviations over the expected distance at the Jaccard similarity.

    For large sets bits differ with probability acos(c) / pi, cosine c = 2s / (1 + s); for small ones,
    whose votes tie, the worst pair of sizes is counted out.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for both in range(1, 13):
        for x in range(both + 1):
            for y in range(x, both + 1):
                if x + y and both >= similarity * (both + x + y) - 1e-9:
                    odd = sum(
                        math.comb(both, s) * math.comb(x, i) * math.comb(y, j)
                        for s in range(both + 1) for i in range(x + 1) for j in range(y + 1)
                        if (2 * (s + i) > both + x) != (2 * (s + j) > both + y)
                    )
                    p = max(p, odd / 2 ** (both + x + y))
    return round(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """The rows of docs less near-duplicates: of each group one stays, the first by doc_id.

    Two documents link if the Jaccard similarity of their sets of `shingle`-word shingles reaches
    `similarity`, counted on the sets.  Candidates come from fingerprints of `lanes` x 64 bits, three
    deviations beyond the expected distance: about one pair in a thousand right at the threshold is lost.
    Rows that share a doc_id stay or go together; rows with a null doc_id stay.  Null and empty
    texts are copies of each other.  An empty table gives an empty table; columns of any name stay.
    """
    radius, gone = candidate_radius(similarity, 64 * lanes), kern.fresh(docs.columns, "_gone")
    near = near_duplicates(docs, shingle, radius, lanes, True, similarity)
    return docs.join(near.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id") == F.col(gone), "left_anti")
