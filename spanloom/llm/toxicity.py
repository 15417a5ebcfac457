"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled documents: one of text that
recurs in toxic documents and is absent from ordinary ones, one of text that
recurs in ordinary documents.  Every window of a document is compressed with
both; a window that is shorter under the toxic dictionary by several bytes speaks
for toxicity.  A logistic calibration, fitted on documents that the dictionaries
behind it have not seen, turns the two largest differences and the counts over
the thresholds into a score.

A window is one word, lower-cased (A-Z) and without outer punctuation, followed
by a pad that both dictionaries hold.  The pad makes zstandard emit a compressed
block in either case, so the header costs cancel and the difference is that of
the word alone.  Equal windows of a block are compressed once.

zstandard's trainer makes both dictionaries, from samples of some windows each:
of the toxic documents those that recur and that ordinary documents lack, of the
ordinary ones those that recur.  Where there is too little for the trainer, the
samples themselves are the dictionary.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern

#: Bounds of the training sample: documents of each label, and bytes of one document (longer ones do not train).
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 1500, 3000, 1 << 16
#: Bytes of each dictionary.
TOXIC_BYTES, ORDINARY_BYTES = 8192, 112_640
#: Windows in a sample of the trainer.
SAMPLE = 12
_PAD = bytes(range(128, 160))
_STRIP = b".,;:!?\"'()[]"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MADE: dict[str, zstandard.ZstdCompressor] = {}


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    coef: tuple[float, ...]
    prior: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    key = hashlib.sha1(content).hexdigest()
    if key not in _MADE:
        # a trained dictionary starts with a magic number and its tables; all after these, the pad included, is content
        d = zstandard.ZstdCompressionDict(content + _PAD, dict_type=zstandard.DICT_TYPE_AUTO)
        p = zstandard.ZstdCompressionParameters(
            write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, chain_log=16, hash_log=16, strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=8, target_length=64
        )
        d.precompute_compress(compression_params=p)
        _MADE[key] = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
    return _MADE[key]


def _lengths(content: bytes, windows: list[bytes]) -> np.ndarray:
    if not windows:
        return np.zeros(0, np.int64)
    got = _compressor(content).multi_compress_to_buffer(windows)
    return np.fromiter((len(got[i]) for i in range(len(windows))), np.int64, len(windows))


def features(texts: list[bytes | None], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For each document: largest and second largest difference, log counts of windows over 2 and over 3 bytes, their share."""
    w = kern.Words(texts, lower=True)
    start, end = kern.trim(w.buf, w.start, w.end, _STRIP)
    _, first, back = np.unique(kern.span_hashes(w.buf, start, end), return_index=True, return_inverse=True)
    windows = [b" " + w.raw[a:b] + b" " + _PAD for a, b in zip(start[first].tolist(), end[first].tolist())]
    d = (_lengths(ordinary, windows) - _lengths(toxic, windows))[back] if windows else np.zeros(0, np.int64)
    out = np.zeros((len(texts), 5))
    over2, over3 = kern.per_doc(w, d >= 3), kern.per_doc(w, d >= 4)
    out[:, 2], out[:, 3] = np.log1p(over2), np.log1p(over3)
    out[:, 4] = np.sqrt(over2 / np.maximum(1, w.count))
    at = np.flatnonzero(d > 0)
    at = at[np.lexsort((-d[at], w.doc[at]))]
    doc, v = w.doc[at], d[at]
    new = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    out[doc[new], 0] = v[new]
    second = np.append(False, new[:-1])[: len(doc)] & ~new
    out[doc[second], 1] = v[second]
    return out


def _words(text: bytes) -> list[bytes]:
    return [x.strip(_STRIP) for x in _WORD.findall(text.lower())]


def _apart(docs: list[bytes]) -> list[list[bytes]]:
    """Word lists, without documents that share over a tenth of their 5-word shingles with earlier ones."""
    seen: set[int] = set()
    out = []
    for t in docs:
        w = _words(t)
        sh = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if len(sh & seen) > 0.1 * len(sh):
            continue
        seen |= sh
        out.append(w)
    return out


def _trained(windows: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes by zstandard's trainer; too few windows are one as they are."""
    random.Random(7).shuffle(windows)
    samples = [b"".join(windows[i : i + SAMPLE]) for i in range(0, len(windows), SAMPLE)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries, trained on the windows that recur in each class; toxic ones are absent from ordinary documents."""
    bad_docs, good_docs = _apart(toxic), _apart(ordinary)
    bad = Counter(x for w in bad_docs for x in set(w) if x)
    good = Counter(x for w in good_docs for x in set(w) if x)
    least = max(3, len(toxic) // 300)
    t = [b" " + x + b" " for w in bad_docs for x in w if x and bad[x] >= least and x not in good]
    o = [b" " + x + b" " for w in good_docs for x in sorted(set(w)) if x and good[x] >= 3]
    return _trained(t, TOXIC_BYTES), _trained(o, ORDINARY_BYTES)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * np.append(b[:-1], 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries on all documents; the calibration on two halves, each measured with the dictionaries of the other."""
    prior = len(toxic) / max(1, len(toxic) + len(ordinary))
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", (), min(prior, 0.49))
    x, y = [], []
    for a in (0, 1):
        d = dictionaries(toxic[a::2], ordinary[a::2])
        for docs, label in ((toxic[1 - a :: 2], 1), (ordinary[1 - a :: 2], 0)):
            x += [features(docs[lo:hi], *d) for lo, hi in kern.blocks(docs)]
            y += [label] * len(docs)
    return Model(*dictionaries(toxic, ordinary), tuple(_logistic(np.concatenate(x), np.array(y)).tolist()), prior)


def fold(doc_id, of: int):
    """crc32 of the decimal doc_id, modulo `of`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most MAX_TOXIC and MAX_ORDINARY rows of labelled documents that are not held out, the least by a hash of doc_id and text; repeated rows count each."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    most = {1: MAX_TOXIC, 0: MAX_ORDINARY}
    # ids are thinned before they meet their texts, rows counted after
    lab = kern.sampled(lab, "y", most, "doc_id", F.lit(7))
    held = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= MAX_BYTES).join(F.broadcast(lab), "doc_id").select("doc_id", "text", "y")
    rows = kern.sampled(held, "y", most, "doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.text)))
    random.Random(7).shuffle(rows)
    return train([bytes(r.text) for r in rows if r.y == 1], [bytes(r.text) for r in rows if r.y == 0])


def scores(texts: list[bytes | None], model: Model) -> np.ndarray:
    if not model.coef:
        return np.full(len(texts), model.prior)
    x = features(texts, model.toxic, model.ordinary)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.coef[:-1]) + model.coef[-1], -30, 30)))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every document, from its whole text alone.

    Null or empty text: the score of a document without toxic windows.  Without
    enough labels of either kind the score is the label's share, but below 0.5: nothing speaks against any document.  Rows repeat as they come; an empty
    table gives an empty table; columns other than doc_id and text are ignored.
    """

    def run(block):
        s = scores(block["text"], model)
        return {"doc_id": block["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return kern.map_text(docs, run, "doc_id long, score double, predicted int", _OUT, limit=4 << 20)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5; every row is judged by its own text, null and empty ones as score says."""
    return kern.keep_by_text(docs, lambda texts: scores(texts, model) < 0.5, 4 << 20)
