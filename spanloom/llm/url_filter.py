"""URL filter: host and path rules first, then a character language-model ratio.

URLs that a rule accepts or rejects train two smoothed variable-order Markov
models.  A model's probability of a character after a context of up to ORDER
characters interpolates with the one after the next shorter context, weighted by
how often the context was seen, so an unseen context falls back by itself.
Every ruled URL of the table counts, and every n-gram has a count of its own: the
counts are a Spark table that grows with the input, keyed by 64-bit hashes (over n
distinct n-grams two share a key with probability n**2 / 2**65).  URLs are scored in
chunks; a chunk asks for each of its distinct n-grams once, by a join.

The score of a URL is the log-likelihood difference divided by its length.  The
threshold is calibrated on ruled URLs held out of the counts, by the histogram of
their scores, at the least balanced error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern, scratch

#: Longest context, pseudo-count that shorter contexts get, bins of the calibration, bytes of URLs in a chunk and positions handled at once.
ORDER, ESCAPE, BINS, CHUNK_BYTES, SLICE = 4, 2.0, 400, 1 << 20, 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, allow: bool) -> Rule:
    """`net/de/` is host net and path /de/."""
    host, slash, path = text.partition("/")
    return Rule(host.lower(), slash + path, allow)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end.  No :// or null: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits; ties by text."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


# ---- the models ------------------------------------------------------------


def _grams(texts: list[bytes | None]):
    """For slices of the texts' positions: keys of (order, context and character), keys of (order, context), and the text of each position; an end mark closes each text."""
    lens = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b"\x01".join(t or b"" for t in texts) + b"\x01", np.uint8)
    first = np.cumsum(lens) - lens
    order = np.arange(1, ORDER + 2, dtype=np.uint64)[:, None]
    for a in range(0, len(raw), SLICE):
        at = np.arange(a, min(len(raw), a + SLICE))
        doc = np.searchsorted(first, at, side="right") - 1
        place = at - first[doc]
        ctx = np.zeros((ORDER + 1, len(at)), np.uint64)
        for o in range(1, ORDER + 1):
            # the context one longer takes the byte o before, or a start mark
            prev = np.where(place >= o, raw[np.maximum(at - o, 0)], 2).astype(np.uint64)
            ctx[o] = kern.mix(ctx[o - 1] * np.uint64(257) + prev + np.uint64(o))
        yield kern.mix(ctx * np.uint64(263) + raw[at].astype(np.uint64)[None] + order * np.uint64(1 << 40)), kern.mix(ctx + order * np.uint64(1 << 41)), doc


_COUNT = pa.schema([("key", pa.int64()), ("accepted", pa.int64()), ("rejected", pa.int64())])


def count_grams(urls: DataFrame) -> DataFrame:
    """(key, accepted, rejected) over a table of url (binary) and accepted (boolean): how often each n-gram and each context occurs on either side."""

    def run(batches):
        for batch in batches:
            t, ok = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for lo, hi in kern.blocks(t):
                for gram, ctx, doc in _grams(t[lo:hi]):
                    side = np.tile(ok[lo:hi][doc], 2 * (ORDER + 1))
                    key, back = np.unique(np.concatenate([gram, ctx]).reshape(-1), return_inverse=True)
                    n = [np.bincount(back, side == x, minlength=len(key)).astype(np.int64) for x in (True, False)]
                    yield from kern.table(_COUNT, key=key.view(np.int64), accepted=n[0], rejected=n[1]).to_batches()

    return urls.mapInArrow(run, "key long, accepted long, rejected long").groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def wanted(texts: list[bytes | None]) -> np.ndarray:
    """The distinct keys that the texts ask for, ascending."""
    out = np.zeros(0, np.uint64)
    for gram, ctx, _ in _grams(texts):
        out = np.union1d(out, np.concatenate([gram, ctx]))
    return out


def log_ratio(texts: list[bytes | None], keys: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood of accepted less that of rejected, from counts of ascending keys; keys not there count zero."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    keys = np.append(keys, np.uint64(2**64 - 1))

    def look(x):
        at = np.searchsorted(keys[:-1], x)
        return at, keys[at] == x

    for gram, ctx, doc in _grams(texts):
        gram, ctx = look(gram), look(ctx)
        out = np.zeros(len(doc))
        for sign, counts in ((1, accepted), (-1, rejected)):
            counts = np.append(counts, 0)
            p = np.full(len(doc), 1 / 256)
            for o in range(ORDER + 1):
                p = (counts[gram[0][o]] * gram[1][o] + ESCAPE * p) / (counts[ctx[0][o]] * ctx[1][o] + ESCAPE)
            out += sign * np.log(p)
        total += np.bincount(doc, out, minlength=len(texts))
        n += np.bincount(doc, minlength=len(texts))
    return total / np.maximum(n, 1)


_KEYS = pa.schema([("chunk", pa.int64()), ("key", pa.int64())])
_RATIO = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("held", pa.bool_()), ("ratio", pa.float64())])
_RATIO_SQL = "page_id long, host string, path string, rule string, held boolean, ratio double"


def ratios(p: DataFrame, counts: DataFrame) -> DataFrame:
    """p (chunk, page_id, url as bytes, host, path, rule, held) with `ratio`, less chunk and url."""

    def ask(key, tab):
        keys = wanted(kern.column(tab, "url"))
        return pa.table([pa.array(np.full(len(keys), key[0].as_py())), pa.array(keys.view(np.int64))], schema=_KEYS)

    def score(key, tab, got):
        k = np.array(got.column("key")).view(np.uint64)
        order = np.argsort(k)
        n = [np.array(got.column(c), np.float64)[order] for c in ("accepted", "rejected")]
        ratio = log_ratio(kern.column(tab, "url"), k[order], *n) if tab.num_rows else []
        return pa.table([*(tab.column(c).combine_chunks() for c in _RATIO.names[:-1]), pa.array(ratio, pa.float64())], schema=_RATIO)

    asked = p.select("chunk", "url").groupBy("chunk").applyInArrow(ask, "chunk long, key long")
    got = asked.join(counts, "key").select("chunk", "key", "accepted", "rejected")
    return p.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(score, _RATIO_SQL)


def threshold(scored: DataFrame) -> float:
    """The score at the least balanced error over held-out ruled URLs (accepted, ratio); the middle one of equals, 0 without both sides."""
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("ratio") + 4) * BINS / 8)))
    hist = np.zeros((2, BINS))
    for r in scored.groupBy(place.alias("bin"), "accepted").count().collect():  # 2 * BINS rows at most
        hist[int(r.accepted), r.bin] += r["count"]
    if not hist[0].sum() or not hist[1].sum():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(hist, axis=1)], axis=1) / hist.sum(axis=1, keepdims=True)
    error = below[1] + 1 - below[0]  # accepted under the threshold, rejected at or over it
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2]) * 8 / BINS - 4


def _draw(key: str, of: int) -> Column:
    """A part of the rows by the MD5 of the key in decimal; null: part 0."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % of, F.lit(0))


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (the longest that fits or null), ratio and verdict (the rule's, else by the ratio) of every page.

    Four fifths of the ruled URLs, by a hash of the key, make the counts, the rest the threshold.
    Null URLs and URLs without :// have empty host and path, no rule, and are scored like
    any other text (null as empty).  Without ruled URLs of both sides all ratios count
    from zero up as allowed.  Very long URLs are scored whole, slice by slice.  Repeated rows are judged
    alike; an empty table gives an empty table; columns other than the key and url are ignored.
    """
    host, path = host_path(F.col("url"))
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), host.alias("host"), path.alias("path"))
    p = p.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("held", _draw("page_id", 5) == 0)
    # rows are numbered once and written, so that both passes see them in the same chunks, however often a key or URL repeats
    p = scratch.stored(p.withColumn("row", F.monotonically_increasing_id()), "urls")
    total = p.agg(F.coalesce(F.sum(F.octet_length("url") + 1), F.lit(0)).alias("b")).first().b
    p = p.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total // CHUNK_BYTES)))).cast("long")).drop("row")
    allow = F.col("rule").isin([r.text for r in rules if r.allow])
    counts = count_grams(p.where(F.col("rule").isNotNull() & ~F.col("held")).select(F.coalesce("url", F.lit(b"")).alias("url"), allow.alias("accepted")))
    scored = scratch.stored(ratios(p, counts), "ratios")
    cut = threshold(scored.where(F.col("rule").isNotNull() & F.col("held")).select("ratio", allow.alias("accepted")))
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("ratio") >= cut, "allow").otherwise("block")).otherwise(F.when(allow, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", "ratio", verdict.alias("verdict"))
