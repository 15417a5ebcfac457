"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers (also in words, and glued to a unit), units
after a number, and capitalised words turn into typed placeholders; other words are
lower-cased and lose outer punctuation.  Capitalised function words stay words, so a
name may begin a sentence.  Names in a row are one placeholder, and so are number
words.  Hashes of windows of template tokens are
joined between documents and benchmark items.  Where enough of an item's windows
meet, on one alignment or on nearby ones in order, the slots are compared: every value
of the item must map to one value of the document, and different names to different
ones, else the match is chance.  So a question with other names and numbers is found,
and told apart from text that merely has its shape.

The words themselves, lower-cased, are a second reading, with stricter demands: it
finds copies in another capitalisation and items that are all numbers or names.

A benchmark of at most INDEX_BYTES is an index that is broadcast; documents are then read once
and never shuffled.  For a larger one the windows of both sides meet in a join, and
only documents and items that share enough of them are compared.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern, scratch

WINDOW = 8
#: Literal (not placeholder) tokens a window needs, as a share, and the least where no window of an item has so many; such an item must meet whole.
LITERALS, FEWEST = 0.5, 2
#: Values beyond the first, over all numbers and units of an item: by chance two slots of an item can hold the same number.
SPLIT = 1
#: Literal tokens that an item of fewer tokens than a window needs for its template to match; with fewer only its words do.
SHORT = 4
#: Share of an item's windows that must meet, and a run of windows that is enough: of template tokens, of plain words.
COVERAGE, RUN = (0.5, 0.75), (12, 24)
#: Tokens by which the alignment may shift from one met window to the next.
DRIFT = 8
INDEX_BYTES = 8 << 20
_STRIP = b".,;:!?\"'()[]"
#: Units of measure and currency (fixed values).
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % $ € £ dollar dollars euro euros cent cents degrees kmh mph kph".split()
#: Number words (fixed values).
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
#: Words that stay words with a capital as well (fixed values).
FUNCTION = (
    "a about after all also although an and any are as at be because before both but by can could did do does during each every find few first for from given had has have he her here his how if in into is it its "
    "last let later many more most much my next no not now of on once one only or other our out over she should since so some such than that the their them then there these they this those through to under until up "
    "was we were what when where which while who whom whose why will with would yet you your"
).split()
_GLUED = re.compile(rb"([0-9][0-9.,]*)([a-z%\x80-\xff]+)")
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65))
_SETS: dict[str, np.ndarray] = {}


def _listed(name: str, words: list[str]) -> np.ndarray:
    if name not in _SETS:
        _SETS[name] = np.sort(kern.Words([x.encode() for x in words]).hashes())
    return _SETS[name]


class Template:
    """Template tokens of a block of texts: hash, kind (0 literal, 1 number, 2 unit, 3 name), byte span and document of each; `raw`: the words."""

    def __init__(self, texts: list[bytes | None]):
        w = kern.Words(texts)
        start, end = kern.trim(w.buf, w.start, w.end, _STRIP)
        low = w.raw.lower()
        h = kern.span_hashes(np.frombuffer(low, np.uint8), start, end)
        self.text, self.raw = low, (h, w.doc, start, end)
        self.hash, self.doc, self.start, self.end, self.kind = h, w.doc, start, end, np.zeros(len(h), np.int8)
        if len(h):
            self._canonicalise(w, low)

    def _canonicalise(self, w: kern.Words, low: bytes) -> None:
        h, start, end, kind, buf = self.hash, self.start, self.end, self.kind, w.buf
        size = end - start
        first = buf[np.minimum(start, len(buf) - 1)]
        digit = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
        numeric = np.zeros(256, bool)
        numeric[list(b"0123456789.,:/%+-$")] = True
        ok = np.concatenate([[0], np.cumsum(numeric[buf])])
        has = digit[end] > digit[start]
        kind[has & (ok[end] - ok[start] == size)] = 1
        glued = {}
        for i in np.flatnonzero(has & (kind == 0) & (first >= 48) & (first <= 57)).tolist():
            m = _GLUED.fullmatch(low, start[i], end[i])
            if m and m[2].decode("utf-8", "replace") in UNITS:
                glued[i] = m.end(1)
        spoken = (kind == 0) & kern.member(h, _listed("numbers", NUMBERS))
        kind[spoken] = 1
        near = np.append(False, (kind[:-1] == 1) & (w.doc[1:] == w.doc[:-1]))
        kind[near & (kind == 0) & kern.member(h, _listed("units", UNITS))] = 2
        second = buf[np.minimum(start + 1, len(buf) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        kind[capital & (kind == 0) & (size > 1) & ~kern.member(h, _listed("function", FUNCTION))] = 3
        doc = w.doc
        # names, or number words, in a row without punctuation between them are one token
        joins = ((kind == 3)[1:] & (kind == 3)[:-1]) | (spoken[1:] & spoken[:-1])
        head = np.append(True, ~(joins & (end[:-1] == w.end[:-1]) & (start[1:] == w.start[1:]) & (doc[1:] == doc[:-1])))
        at = np.flatnonzero(head)
        end = end[np.append(at[1:], len(h)) - 1]
        start, kind, doc, h = start[at], kind[at], doc[at], h[at]
        if glued:  # a number and its unit are two tokens
            i = np.searchsorted(at, np.array(list(glued)))
            twice = np.ones(len(at), np.int64)
            twice[i] = 2
            here = np.cumsum(twice) - twice
            start, end, kind, doc, h = (np.repeat(x, twice) for x in (start, end, kind, doc, h))
            cut = np.array(list(glued.values()))
            end[here[i]], start[here[i] + 1] = cut, cut
            kind[here[i]], kind[here[i] + 1] = 1, 2
        self.hash = np.where(kind == 0, h, np.choose(kind, [np.uint64(0), _NUM, _UNIT, _NAME]))
        self.start, self.end, self.kind, self.doc = start, end, kind, doc

    def windows(self, k: int, raw: bool = False, weak: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows of k tokens, and the first token of each: of plain words, or of template tokens with enough literals."""
        if raw:
            return kern.windows(self.raw[1], self.raw[0], k)
        h, at = kern.windows(self.doc, self.hash, k)
        literal = np.concatenate([[0], np.cumsum(self.kind == 0)])
        keep = literal[at + k] - literal[at] >= (FEWEST if weak else LITERALS * k) if len(at) else np.zeros(0, bool)
        return h[keep], at[keep]

    def value(self, i: int, raw: bool = False) -> bytes:
        start, end = self.raw[2:] if raw else (self.start, self.end)
        return b" ".join(self.text[start[i] : end[i]].split())


@dataclass(frozen=True)
class Item:
    """One reading of a benchmark item: kinds and values of its tokens, its windows, and how many must meet."""

    item_id: int
    number: int
    kinds: tuple[int, ...]
    values: tuple[bytes, ...]
    windows: int
    need: float


@dataclass(frozen=True)
class Index:
    """For each (raw or not, window length): sorted hashes with the reading's number and first token of each."""

    items: tuple[Item, ...]
    tables: dict
    weak: bool

    @staticmethod
    def of(rows: list[tuple[int, bytes]], k: int = WINDOW) -> "Index":
        items, found, weak = [], defaultdict(list), False
        for number, (item_id, text) in enumerate(rows):
            for raw, length, need, h, at, t in readings(text, k):
                kinds = (0,) * len(t.raw[0]) if raw else tuple(t.kind.tolist())
                found[raw, length] += [(x, len(items), a) for x, a in zip(h.tolist(), at.tolist())]
                items.append(Item(item_id, number, kinds, tuple(t.value(i, raw) for i in range(len(kinds))), len(h), need))
                weak |= not raw and need >= len(h)
        tables = {}
        for key, hits in found.items():
            hits.sort()
            tables[key] = (np.array([x[0] for x in hits], np.uint64), np.array([x[1] for x in hits]), np.array([x[2] for x in hits]))
        return Index(tuple(items), tables, weak)


def readings(text: bytes, k: int = WINDOW):
    """(raw or not, window length, windows that must meet, hashes, first tokens, template) of an item's readings; of fewer than 4 tokens there is none."""
    t = Template([text])
    for raw, n in ((False, len(t.kind)), (True, len(t.raw[0]))):
        if n < 4 or not raw and n < k and (t.kind == 0).sum() < SHORT:
            continue
        # short templates have shorter windows, so that one inserted word does not spoil most of them
        length = min(k, n) if raw or n < k else min(k, max(4, (n - 3) // 2))
        h, at = t.windows(length, raw)
        need = len(h) if n < k else min(RUN[raw], COVERAGE[raw] * len(h))
        if not len(h):
            h, at = t.windows(length, raw, True)
            need = len(h)
        if len(h):
            yield raw, length, need, h, at, t


def _clash(held: dict, key: tuple[int, bytes], value: bytes) -> bool:
    """The key already has another value; a name may be given in full or in part."""
    old = held.setdefault(key, value)
    if old == value:
        return False
    a, b = set(old.split()), set(value.split())
    return key[0] != 3 or not (a <= b or b <= a)


def _consistent(item: Item, t: Template, pairs: list[tuple[int, int]], k: int, raw: bool) -> tuple[bool, bool]:
    """(slots map to one value each and names apart, all tokens are the same) over the aligned windows."""
    forward, back, same, extra = {}, {}, True, 0
    seen: dict[tuple[int, bytes], set[bytes]] = {}  # all values that a number or unit stands for
    for i, of in dict.fromkeys((at + j, of + j) for at, of in pairs for j in range(k)):
        a, b, kind = item.values[of], t.value(i, raw), item.kinds[of]
        same &= a == b
        if kind == 3:
            if _clash(forward, (kind, a), b) or _clash(back, (kind, b), a):
                return False, False
        elif kind:
            values = seen.setdefault((kind, a), set())
            extra += bool(values) and b not in values
            values.add(b)
    return extra <= SPLIT, same


def _chain(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The longest run of met windows that ascend in document and item, each within DRIFT of the alignment before it."""
    pairs = sorted(set(pairs))
    size, back, lo = [1] * len(pairs), [-1] * len(pairs), 0
    for i, (a, of) in enumerate(pairs):
        while pairs[lo][0] < a - reach - DRIFT:
            lo += 1
        for j in range(lo, i):
            b, og = pairs[j]
            if b < a and og < of and abs((a - of) - (b - og)) <= DRIFT and size[j] >= size[i]:
                size[i], back[i] = size[j] + 1, j
    at = max(range(len(pairs)), key=size.__getitem__)
    out = []
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def match(texts: list[bytes | None], index: Index, k: int = WINDOW) -> list[tuple[int, Item, int, float, str]]:
    """(document, item, windows met, coverage, kind) of every contaminated pair."""
    best: dict = {}
    t = Template(texts)
    for (raw, length), (hashes, items, offsets) in index.tables.items():
        h, at = t.windows(length, raw, index.weak)
        doc_of = t.raw[1] if raw else t.doc
        hit = np.flatnonzero(kern.member(h, hashes))
        if not len(hit):
            continue
        lo, hi = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
        met = defaultdict(list)
        for a, x, y in zip(at[hit].tolist(), lo.tolist(), hi.tolist()):
            for e in range(x, y):
                met[(int(doc_of[a]), int(items[e]))].append((a, int(offsets[e])))
        for (doc, entry), pairs in sorted(met.items()):
            item = index.items[entry]
            if len({of for _, of in pairs}) < item.need:
                continue
            # windows align on diagonals, and an inserted or missing word shifts to another; the best run decides, a repeated passage is one match
            lines = defaultdict(list)
            for a, of in pairs:
                lines[a - of].append((a, of))
            runs = [lines[shift] for shift in sorted(lines)]
            if len(runs) > 1 and max(len({of for _, of in run}) for run in runs) < item.windows:
                runs.insert(0, _chain(pairs, len(item.kinds)))
            for run in runs:
                n = len({of for _, of in run})
                old = best.get((doc, item.number))
                if n >= item.need and (old is None or n / item.windows > old[3]):
                    ok, same = _consistent(item, t, run, length, raw)
                    if ok:
                        one = len({a - of for a, of in run}) == 1
                        kind = "reparameterised" if not (same and one) else "verbatim" if n == item.windows else "partial"
                        best[doc, item.number] = (doc, item, n, n / item.windows, kind)
    return [best[x] for x in sorted(best)]


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("coverage", pa.float64()), ("kind", pa.string())])
_OUT_SQL = "doc_id long, item_id long, n_windows long, coverage double, kind string"


def _columns(ids, found) -> dict:
    return {"doc_id": [ids[d] for d, *_ in found], "item_id": [i.item_id for _, i, *_ in found], "n_windows": [f[2] for f in found], "coverage": [f[3] for f in found], "kind": [f[4] for f in found]}


def _items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, bool]:
    """Distinct (item_id, text as bytes) of the benchmark, and whether they fit in INDEX_BYTES."""
    b = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("binary").alias("item_text")).where(F.col("item_text").isNotNull()).distinct()
    return b, b.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0)).alias("n")).first().n <= INDEX_BYTES


def _index(b: DataFrame, k: int) -> Index:
    return Index.of(sorted((r.item_id if r.item_id is not None else -1, bytes(r.item_text)) for r in b.collect()), k)  # bounded by INDEX_BYTES


_PAIR = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("need", pa.int32())])


def _by_join(rows: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Matches of rows (row, text as bytes) with items, as _OUT with row for doc_id, by a join of window hashes."""
    b = scratch.stored(b.withColumn("item", F.monotonically_increasing_id()), "items")

    def salted(h, raw, length):
        return kern.mix(h + np.uint64(length * 2 + raw)).view(np.int64)

    def of_items(batches):
        for batch in batches:
            for text, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for raw, length, need, h, _, _ in readings(text, k):
                    # so many distinct windows must meet at least, if those that repeat in the item are met first
                    times = np.sort(np.unique(h, return_counts=True)[1])[::-1]
                    least = int(np.searchsorted(np.cumsum(times), need)) + 1
                    u = salted(np.unique(h), raw, length)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.full(len(u), 2 * item + raw)), pa.array(np.full(len(u), least, np.int32))], schema=_PAIR)

    def of_rows(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in kern.blocks(texts):
                t = Template(texts[lo:hi])
                for length in range(4, k + 1):
                    for raw in (False, True):
                        h, at = t.windows(length, raw, True)
                        doc = (t.raw[1] if raw else t.doc)[at]
                        u = np.unique(np.stack([salted(h, raw, length), doc]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(np.array(ids[lo:hi], np.int64)[u[1]]), pa.array(np.zeros(u.shape[1], np.int32))], schema=_PAIR)

    of_b = b.select("item_text", "item").mapInArrow(of_items, "h long, row long, need int").withColumnRenamed("row", "reading")
    pairs = rows.select("row", "text").mapInArrow(of_rows, "h long, row long, need int").drop("need").join(of_b, "h").groupBy("row", "reading").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    pairs = pairs.where("n >= need").select("row", F.shiftright("reading", 1).alias("item")).distinct()
    found = pairs.join(b, "item").join(rows.select("row", "text"), "row").select("row", "text", "item_id", "item_text")

    def compare(batches):
        for batch in batches:
            out = {n: [] for n in _OUT.names}
            for row, text, item_id, item_text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for n, c in _columns([row], match([text], Index.of([(item_id if item_id is not None else -1, item_text)], k), k)).items():
                    out[n] += c
            yield from kern.table(_OUT, **out).to_batches()

    return found.mapInArrow(compare, _OUT_SQL).withColumnRenamed("doc_id", "row")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of row numbers, written, so that every pass sees the same numbers."""
    return scratch.stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """A row (doc_id, item_id, n_windows, coverage, kind) for each document and benchmark item that it holds; clean documents have none.

    kind: verbatim if the whole item is there and all tokens are equal, partial if all that met is equal but some windows did not
    meet, else reparameterised.  Items of 4 to window - 1 tokens must meet whole; shorter ones and null texts never.  An item none of whose
    windows is at least half literals must meet whole; one with fewer than FEWEST is matched by its words as they are, not
    with other names or numbers.  Null or empty documents
    hold nothing.  Repeated rows each give their matches; equal items share hashes and each
    give a row; a null item_id counts as -1.  Empty tables: no rows.  Other columns are ignored, whatever their names.  Texts are scanned whole.
    """
    b, small = _items(benchmark, item, text)
    if not small:
        rows = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), "row")
        return _by_join(rows, b, window).join(rows.select("row", "doc_id"), "row").select(*_OUT.names)
    held = docs.sparkSession.sparkContext.broadcast(_index(b, window))

    def run(block):
        found = match(block["text"], held.value, window)
        return _columns(block["doc_id"], found) if found else None

    return kern.map_text(docs, run, _OUT_SQL, _OUT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; null and empty texts, repeated rows and columns of any name stay as they are."""
    b, small = _items(benchmark, "item_id", "text")
    names = docs.columns
    if not small:
        mark = kern.fresh(names, "row")
        rows = _numbered(docs, mark)
        found = _by_join(rows.select(F.col(mark).alias("row"), F.col("text").cast("binary").alias("text")), b, window).select(F.col("row").alias(mark)).distinct()
        return rows.join(found, mark, "left_anti").select(*kern.cols(names))
    held = docs.sparkSession.sparkContext.broadcast(_index(b, window))
    return kern.keep_by_text(docs, lambda texts: _clean(texts, held.value, window))


def _clean(texts: list[bytes | None], index: Index, k: int) -> np.ndarray:
    keep = np.ones(len(texts), bool)
    keep[[d for d, *_ in match(texts, index, k)]] = False
    return keep
