"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A bounded sample of documents measures, for every rule, the seconds it takes and
the share it rejects.  The cascade then runs rules by rejections per second; a
document leaves at the first rule it fails, so later rules see fewer documents.
A document is kept if it passes all rules, so the order changes the time and
never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern

#: Documents that the cost sample holds, about.
SAMPLE = 400
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Features:
    """Statistics of a block of documents, each computed when a rule first asks for it."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = texts
        self.words = kern.Words(texts)
        self._got: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._got:
            self._got[name] = getattr(self, f"_{name}")()
        return self._got[name]

    def _n_words(self):
        return self.words.count

    def _bytes_of_doc(self, flag: np.ndarray) -> np.ndarray:
        acc = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        ends = np.append(self.words.doc_start[1:], len(self.words.buf))
        return acc[ends] - acc[self.words.doc_start]

    def _word_chars(self):
        b = self.words.buf
        return self._bytes_of_doc(((b & 0xC0) != 0x80) & ~kern._SEP[b])

    def _n_symbols(self):
        return self._bytes_of_doc(_SYMBOL[self.words.buf])

    def _n_upper(self):
        b = self.words.buf
        return self._bytes_of_doc((b >= 65) & (b <= 90))

    def _lines(self):
        """Lines with a word: their document and a flag for those equal to an earlier one."""
        b = self.words.buf
        cut = np.flatnonzero(b == 10)
        start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(b)]])
        first = np.searchsorted(self.words.start, start)
        full = np.flatnonzero(np.append(self.words.start, len(b) + 1)[first] < end)
        start, end = start[full], end[full]
        doc = np.searchsorted(self.words.doc_start, start, side="right") - 1
        key = kern.mix(kern.span_hashes(b, start, end) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        dup = np.zeros(len(key), bool)
        dup[order[1:]] = key[order[1:]] == key[order[:-1]]
        n = len(self.texts)
        return np.stack([np.bincount(doc, minlength=n), np.bincount(doc[dup], minlength=n)])

    def _n_lines(self):
        return self["lines"][0]

    def _n_dup_lines(self):
        return self["lines"][1]

    def _n_repeat_words(self, k: int = 5):
        w = self.words
        h, at = w.windows(w.hashes(), k)
        key = kern.mix(h ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        return kern.per_doc(w, kern.covered(len(w.start), at[n[back] > 1], k))


@dataclass(frozen=True)
class Rule:
    """`fails(features)` is true for the documents the rule rejects."""

    name: str
    fails: Callable[[Features], np.ndarray]


#: Documents below 10 words or with over a fifth of their words in repeated 5-word windows fail the base test;
#: the other thresholds follow the published web-text rules (symbols per word, mean word length, duplicate lines).
RULES = (
    Rule("few_words", lambda f: f["n_words"] < 10),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > 2 * f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("duplicate_lines", lambda f: 100 * f["n_dup_lines"] > 30 * f["n_lines"]),
    Rule("shouting", lambda f: 2 * f["n_upper"] > f["word_chars"]),
)


def measure(texts: list[bytes | None], rules=RULES) -> list[tuple[str, float, int, int]]:
    """(name, seconds, documents rejected, documents) of each rule on a block; each rule starts with fresh features."""
    out = []
    for r in rules:
        began = time.perf_counter()
        bad = r.fails(Features(texts))
        out.append((r.name, time.perf_counter() - began, int(np.sum(bad)), len(texts)))
    return out


def ordered(rules, figures) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    by = {n: rejected / max(sec, 1e-9) for n, sec, rejected, _ in figures}
    return sorted(rules, key=lambda r: (-by.get(r.name, 0.0), r.name))


def cascade(texts: list[bytes | None], rules: list[Rule]) -> tuple[np.ndarray, list[str | None]]:
    """Verdict and first failed rule of each document; each rule sees only those that passed the ones before."""
    left = np.arange(len(texts))
    failed: list[str | None] = [None] * len(texts)
    feats, have = None, -1
    for r in rules:
        if not len(left):
            break
        if feats is None or len(left) * 2 < have:  # most have gone: build on what is left
            base, feats, have = left, Features([texts[i] for i in left]), len(left)
        bad = np.asarray(r.fails(feats))
        alive = np.isin(base, left, assume_unique=True)
        for i in base[bad & alive]:
            failed[i] = r.name
        left = base[~bad & alive]
    kept = np.zeros(len(texts), bool)
    kept[left] = True
    return kept, failed


_FIGURE = pa.schema([("rule", pa.string()), ("sec", pa.float64()), ("rejected", pa.int64()), ("docs", pa.int64())])


def plan(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> list[Rule]:
    """Order the rules by a sample of about `sample` documents, a part of the hash space of doc_id and text; executors measure, only figures return."""
    share = min(1.0, sample / max(1, docs.count()))

    def run(block):
        got = measure(block["text"], rules)
        return dict(zip(_FIGURE.names, zip(*got))) if got else None

    part = docs.where(kern.lower_part(share, "doc_id", "text"))
    figures = kern.map_text(part, run, "rule string, sec double, rejected long, docs long", _FIGURE).groupBy("rule").agg(F.sum("sec"), F.sum("rejected"), F.sum("docs")).collect()
    return ordered(rules, figures)


_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("failed_rule", pa.string())])


def judge(docs: DataFrame, rules=RULES, digest: bool = False) -> DataFrame:
    """Verdict of each document: doc_id, kept, failed_rule (the first failed in cascade order); `digest` adds the statistics.

    Null or empty text has no words and is rejected by few_words.  Very long texts
    are measured whole.  Repeated rows are judged alike; an empty table gives an
    empty table; columns other than doc_id and text are ignored.
    """
    order = plan(docs, rules)

    def run(block):
        texts = block["text"]
        kept, failed = cascade(texts, order)
        out = {"doc_id": block["doc_id"], "kept": kept, "failed_rule": failed}
        f = Features(texts) if digest else None
        for n in _OUT.names[1:6]:
            out[n] = f[n] if digest else [None] * len(texts)
        out["base_failed"] = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"]) if digest else [None] * len(texts)
        return out

    schema = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'boolean' if f.type == pa.bool_() else 'string'}" for f in _OUT)
    return kern.map_text(docs, run, schema, _OUT)
