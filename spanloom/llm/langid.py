"""Language ID by hierarchical discrimination.

A text is a bag of byte trigrams (A-Z lower-cased, other ASCII non-letters as
spaces), hashed into a fixed number of features and divided by their number.  One
linear support vector machine for each pair of families votes for the family;
inside it, one for each pair of languages votes for the language.  All machines
are trained here, by dual coordinate descent on the hinge loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern
from spanloom.llm.toxicity import fold

#: Features, and the bound of the training sample: documents of each language.
DIM, PER_LANG = 1 << 13, 400
#: Languages learned, and rows that all of them train on.
MAX_LANGS, MAX_ROWS = 200, 16_000
_SCALE = 20.0
#: Families of closely related languages, by ISO 639-1 code (fixed values); a code not listed is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
#: Three-letter codes of languages in the table (fixed values).
THREE = dict(x.split(":") for x in "afr:af dan:da deu:de ger:de eng:en fry:fy isl:is ice:is nld:nl dut:nl nor:no swe:sv cat:ca spa:es fra:fr fre:fr glg:gl ita:it oci:oc por:pt ron:ro rum:ro bel:be bul:bg bos:bs ces:cs cze:cs hrv:hr mkd:mk pol:pl rus:ru slk:sk slv:sl srp:sr ukr:uk est:et fin:fi hun:hu aze:az kaz:kk tur:tr uzb:uz".split())
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def family(lang: str) -> str:
    """The family of a code, by its first part in two or three letters (en-US, eng); a language not listed is its own."""
    code = re.split("[-_]", lang.lower())[0]
    code = THREE.get(code, code)
    return next((f for f, langs in FAMILIES.items() if code in langs), lang)


def features(raw: np.ndarray) -> np.ndarray:
    """The feature of the trigram that starts at each byte but the last two."""
    b = _FOLD[raw]
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1)).astype(np.int64)


def bag(text: bytes) -> np.ndarray:
    """Relative frequencies of the features of one text, over whole text in slices."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    out = np.zeros(DIM)
    for a in range(0, max(1, len(raw) - 2), kern.BLOCK):
        out += np.bincount(features(raw[a : a + kern.BLOCK + 2]), minlength=DIM) if len(raw) - a > 2 else 0
    return out / max(1.0, out.sum())


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 60, seed: int = 1) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss, dual coordinate descent); the last is the bias."""
    x = np.column_stack([x * _SCALE, np.ones(len(x))]).astype(np.float32)
    w, alpha, q = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if new != alpha[i]:
                w += ((new - alpha[i]) * y[i]) * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3 * c:
            break
    return w


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    families: tuple[str, ...]
    family_pairs: tuple[tuple[int, int], ...]
    lang_pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray  # (DIM, machines), families first
    bias: np.ndarray


def train(bags: np.ndarray, langs: list[str]) -> Model | None:
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    fams = tuple(sorted({family(x) for x in names}))
    lang, fam = np.array([names.index(x) for x in langs]), np.array([fams.index(family(x)) for x in langs])
    fpairs = tuple(combinations(range(len(fams)), 2))
    lpairs = tuple((a, b) for a, b in combinations(range(len(names)), 2) if family(names[a]) == family(names[b]))
    ws = []
    for (a, b), of in [(p, fam) for p in fpairs] + [(p, lang) for p in lpairs]:
        at = np.flatnonzero((of == a) | (of == b))
        ws.append(svm(bags[at], np.where(of[at] == a, 1.0, -1.0)))
    w = np.array(ws, np.float32).reshape(len(ws), DIM + 1)
    return Model(names, fams, fpairs, lpairs, np.ascontiguousarray(w[:, :-1].T * np.float32(_SCALE)), w[:, -1].copy())


_BAG = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("val", pa.binary())])


def fit(docs: DataFrame) -> Model | None:
    """Train on at most PER_LANG documents of each language outside the held-out fold, the least by a hash of doc_id and text; executors make the bags.

    Rows count, not ids: repeated rows are one document each, and no more than the bound reach the driver.  The MAX_LANGS largest
    languages are learned (equal sizes: by code), and all together train on MAX_ROWS rows, which is 0.5 GB.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    langs = [r.lang for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    if not langs:
        return None
    part = kern.sampled(d.select("doc_id", "lang", "text"), "lang", dict.fromkeys(langs, min(PER_LANG, max(20, MAX_ROWS // len(langs)))), "doc_id", "text")

    def run(block):
        bags = [bag(t) for t in block["text"]]
        at = [np.flatnonzero(b) for b in bags]
        return {"doc_id": block["doc_id"], "lang": block["lang"], "at": [a.astype(np.int16).tobytes() for a in at], "val": [b[a].astype(np.float32).tobytes() for a, b in zip(at, bags)]}

    rows = kern.map_text(part, run, "doc_id long, lang string, at binary, val binary", _BAG, ("lang",)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.at), bytes(r.val)))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(bytes(r["at"]), np.int16)] = np.frombuffer(bytes(r["val"]), np.float32)
    return train(x, [r.lang for r in rows])


def margins(texts: list[bytes | None], model: Model) -> np.ndarray:
    """The machines' outputs for each text."""
    m = model.weights.shape[1]
    out = np.zeros((len(texts), m))
    raw = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lens = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(lens + 1)])
    n = len(raw) - 2
    for a in range(0, n, kern.BLOCK):
        b = min(n, a + kern.BLOCK)
        f = features(raw[a : b + 2])
        lo, hi = np.clip(start[:-1], a, b) - a, np.clip(start[:-1] + lens, a, b) - a
        for k in range(m):
            acc = np.concatenate([[0.0], np.cumsum(model.weights[f, k], dtype=np.float64)])
            out[:, k] += acc[hi] - acc[lo]
    return out / np.maximum(1, lens)[:, None] + model.bias


def _vote(pairs, out: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes and, to break ties, summed margins of each class."""
    votes, sums = np.zeros((len(out), of)), np.zeros((len(out), of))
    for k, (a, b) in enumerate(pairs):
        win = out[:, k] >= 0
        votes[:, a] += win
        votes[:, b] += ~win
        sums[:, a] += out[:, k]
        sums[:, b] -= out[:, k]
    return votes, sums


def predict(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray]:
    out = margins(texts, model)
    nf = len(model.family_pairs)
    votes, sums = _vote(model.family_pairs, out[:, :nf], len(model.families))
    fam = np.argmax(votes + 1e-6 * np.tanh(sums), axis=1)
    conf = np.ones(len(texts))
    for k, (a, b) in enumerate(model.family_pairs):
        conf = np.where(fam == a, np.minimum(conf, 1 / (1 + np.exp(-4 * out[:, k]))), np.where(fam == b, np.minimum(conf, 1 / (1 + np.exp(4 * out[:, k]))), conf))
    votes, sums = _vote(model.lang_pairs, out[:, nf:], len(model.langs))
    own = np.array([[family(x) == f for x in model.langs] for f in model.families])
    lang = np.argmax(np.where(own[fam], votes + 1e-6 * np.tanh(sums), -1), axis=1)
    for k, (a, b) in enumerate(model.lang_pairs):
        s = out[:, nf + k]
        conf = np.where(lang == a, np.minimum(conf, 1 / (1 + np.exp(-4 * s))), np.where(lang == b, np.minimum(conf, 1 / (1 + np.exp(4 * s))), conf))
    return [model.langs[i] for i in lang], conf


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the weakest deciding machine) of every document, from its whole text alone.

    Null text and text without a letter: `und` with score 0; also everything if the
    model has learned no language.  Rows repeat as they come; an empty table gives an empty table;
    columns other than doc_id and text are ignored.
    """
    lettered = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_has_letter"))

    def run(block):
        n = len(block["text"])
        names, conf = predict(block["text"], model) if model else (["und"] * n, np.zeros(n))
        ok = block["_has_letter"]
        return {"doc_id": block["doc_id"], "lang_pred": [x if o else "und" for x, o in zip(names, ok)], "score": np.where(ok, conf, 0.0)}

    return kern.map_text(lettered, run, "doc_id long, lang_pred string, score double", _OUT, ("_has_letter",))
