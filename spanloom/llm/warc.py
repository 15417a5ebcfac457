"""WARC archives: a writer and a salvage reader.

Writer: a response record for each page; of pages with equal payloads the one
with the largest id is the response and the others are revisits that refer to it.
Archives are WARC/1.1, a gzip member for each record, and are written by Spark's
own text writer, so its commit protocol holds and a lost executor leaves no half
archive.  That writer ends each row with a separator; a gzip member ends with the
high byte of its length, which is zero below 16 MiB, so with a zero byte as the
separator a row is a member less its last byte.  A longer record is followed by
an empty member, which ends in zero as well.

Reader: records are parsed in order.  After a failed check (version line,
headers, length, closing blank lines, block digest, or a gzip member that does
not inflate) the reader searches for the next version line or gzip member that
passes all checks, goes on there and logs the bytes between as a quarantined gap.
The same holds inside a gzip member, which may hold one record or a whole
archive: it is inflated piece by piece, and records before and after a bad one,
or before the point where the member breaks, are recovered.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import kern, scratch

_DATE = "2024-01-01T00:00:00Z"
#: Bytes given to the inflater and taken from it at once, and the smallest piece tried where a member breaks.
_FEED, _DRAWN, _LEAST = 1 << 16, 1 << 20, 64
#: Headers and block of a record at most; longer ones could not be rows, and a broken length must not hold the rest of a member.
MOST_HEAD, MOST_BLOCK = 64 << 20, 1 << 30
#: Records in an archive at most.
PER_ARCHIVE = 1000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record, with both digests; a revisit keeps the HTTP headers, and so the full length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else record_id(page_id)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record for each row under `path`.

    Null payloads are empty and count as equal to empty ones.  Rows that share the
    largest id and the payload are all responses; a null id is below all others, and where
    all ids are null all are responses.  An empty table writes no record.
    Only copies are joined: payloads found once need no partner.
    """
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    copies = p.groupBy(F.col("digest").alias("d"), size.alias("z")).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).where("n > 1").select("d", "keeper")
    p = p.join(copies, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", "digest", "keeper")

    def run(batches):
        for batch in batches:
            out = []
            for page_id, u, data, digest, keeper in zip(*(batch.column(i).to_pylist() for i in range(5))):
                revisit = keeper is not None and keeper != page_id
                out.append(member(record(page_id, u, data, base64.b32encode(bytes.fromhex(digest)).decode(), keeper, revisit))[:-1])
                if len(out) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    p.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", PER_ARCHIVE).option("lineSep", "\0").text(path)


def member(data: bytes) -> bytes:
    """A record as gzip, ending in a zero byte."""
    def pack(x: bytes) -> bytes:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    out = pack(data)
    return out if out.endswith(b"\0") else out + pack(b"")


# ---- salvage -----------------------------------------------------------------


@dataclass
class Record:
    """offset and length: bytes of the archive; inside: (offset, length) in the inflated gzip member; checked: the block digest was there and right."""

    offset: int
    length: int
    headers: dict
    block: bytes
    checked: bool
    inside: tuple[int, int] | None = None


@dataclass
class Gap:
    """Quarantined bytes; inside: where in the inflated member, whose own bytes are sound."""

    offset: int
    length: int
    reason: str
    inside: tuple[int, int] | None = None


_VERSION = re.compile(rb"WARC/(?:0\.17|0\.18|1\.0|1\.1)\r\n")
_LINE_END = re.compile(rb"\r\n")
#: A version line or a gzip member; the fourth byte of a member has its upper three bits clear.
_MARKER = re.compile(rb"WARC/|\x1f\x8b\x08[\x00-\x1f]")


def _parse(data, at: int, final: bool = True) -> tuple[Record | None, str, int]:
    """(record, reason, bytes needed): the record at an offset of plain WARC bytes, why there is none, or how many bytes it takes to tell."""
    left = len(data) - at
    if not final and left < 11:
        return None, "", 11
    head = _VERSION.match(data, at, at + 11)
    if not head:
        return None, "no version line" if bytes(data[at : at + 5]) != b"WARC/" else "bad version line", 0
    headers, start = {}, head.end()
    while True:
        line = _LINE_END.search(data, start, at + MOST_HEAD)
        if not line:
            return (None, "", 2 * left) if not final and left < MOST_HEAD else (None, "headers do not end", 0)
        row, start = bytes(data[start : line.start()]), line.end()
        if not row:
            break
        name, colon, value = row.partition(b":")
        if not colon:
            return None, "bad header line", 0
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, "bad Content-Length", 0
    if len(size) > 18 or int(size) > MOST_BLOCK:
        return None, "block too long", 0
    stop = start + int(size)
    if len(data) < stop + 4:
        return (None, "", stop + 4 - at) if not final else (None, "truncated", 0)
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        return None, "block does not end in blank lines", 0
    block = bytes(data[start:stop])
    want = headers.get("warc-block-digest", "")
    known = want.lower().startswith("sha1:")
    if known and want[5:].upper() != sha1_base32(block):
        return None, "block digest differs", 0
    return Record(at, stop + 4 - at, headers, block, known), "", 0


class _Plain:
    """Salvages records from plain bytes that come in pieces; holds no more than the record at hand."""

    def __init__(self):
        self.buf, self.base, self.at, self.need = bytearray(), 0, 0, 0
        self.bad, self.why, self.lost = -1, "", False

    def feed(self, piece: bytes, final: bool = False):
        """The (inside, record or reason) that the bytes so far settle: records, and gaps as reasons."""
        self.buf += piece
        while self.at < len(self.buf):
            if self.lost:
                hit = self.buf.find(b"WARC/", self.at)
                if hit < 0:
                    self.at = len(self.buf) if final else max(self.at, len(self.buf) - 4)
                    break
                self.at, self.lost = hit, False
            if not final and len(self.buf) - self.at < self.need:
                break
            record, why, self.need = _parse(self.buf, self.at, final)
            if self.need:
                break
            here = self.base + self.at
            if record is None:
                if self.bad < 0:
                    self.bad, self.why = here, why
                self.at, self.lost = self.at + 1, True
                continue
            if self.bad >= 0:
                yield (self.bad, here - self.bad), self.why
                self.bad = -1
            yield (here, record.length), record
            self.at += record.length
        if self.at > _DRAWN or final:
            del self.buf[: self.at]
            self.base, self.at = self.base + self.at, 0
        if final and self.bad >= 0:
            yield (self.bad, self.base - self.bad), self.why


def _inflated(view, at: int):
    """Pieces of the gzip member at an offset; returns (bytes of the member, "", where it ends), or where it breaks (0, reason, where it was broken), after all that inflates before that."""
    z, fed, rest = zlib.decompressobj(31), at, b""
    while not z.eof:
        before = z.copy() if fed > at else zlib.decompressobj(31)
        if not rest:
            if fed >= len(view):
                return 0, "truncated", fed
            rest = view[fed : fed + _FEED]
            fed += len(rest)
        try:
            out = z.decompress(rest, _DRAWN)
        except zlib.error as e:
            # the failing call's output is lost: go there again in small steps, and in the one that fails byte by byte
            b = len(rest)
            for a in range(0, len(rest), _LEAST):
                saved = before.copy()
                try:
                    out = before.decompress(rest[a : a + _LEAST])
                except zlib.error:
                    for b in range(a, a + _LEAST):
                        try:
                            out = saved.decompress(rest[b : b + 1])
                        except zlib.error:
                            break
                        if out:
                            yield out
                    break
                yield out
            return 0, f"gzip: {str(e).partition(':')[2].strip() or 'error'}", fed - len(rest) + b
        rest = z.unconsumed_tail
        yield out
    return fed - at - len(z.unused_data), "", fed - len(z.unused_data)


def _drained(pieces):
    """What a generator returns."""
    while True:
        try:
            next(pieces)
        except StopIteration as e:
            return e.value


def _key(r: Record) -> bytes:
    return hashlib.sha1(repr(sorted(r.headers.items())).encode() + r.block).digest()


def scan(data):
    """Every record of an archive (plain, or gzip by record, by several or whole) that passes all checks, and every gap, as they are met.

    Sound members, plain records and gaps without `inside` cover the archive once.  Records
    from a member that breaks lie in its gap.  The bytes are searched once from front to end; records that a
    broken member has given are not given again where its stored blocks hold them in plain bytes.
    """
    view = memoryview(data).cast("B")
    at, bad, why = 0, -1, ""
    given: set[bytes] = set()
    until = 0
    while at < len(view):
        length, found = 0, False
        if view[at : at + 3] == b"\x1f\x8b\x08":
            # once for its length, once for its records, so that neither is held
            length, reason, reach = _drained(_inflated(view, at))
            if at >= until:
                given.clear()
            plain, held = _Plain(), []
            for piece in itertools.chain(_inflated(view, at), [None]):
                for inside, got in plain.feed(piece or b"", piece is None):
                    if isinstance(got, Record):
                        found = True
                        if not length:
                            if at < until and _key(got) in given:
                                continue
                            given.add(_key(got))
                        yield Record(at, length, got.headers, got.block, got.checked, inside)
                    else:
                        held.append((inside, got))
            if length and held and not found:
                length, reason = 0, held[0][1]
            elif length:
                for inside, got in held:
                    yield Gap(at, length, got, inside)
            else:
                until = max(until, reach)
        else:
            record, reason, _ = _parse(view, at)
            if record and at < until and _key(record) in given:
                bad, why = (at, "given before") if bad < 0 else (bad, why)
                hit = _MARKER.search(view, at + record.length)
                at = hit.start() if hit else len(view)
                continue
            if record:
                length = record.length
        if length:
            if bad >= 0:
                yield Gap(bad, at - bad, why)
                bad = -1
            if view[at] != 0x1F:
                yield record
            at += length
            continue
        if bad < 0:
            bad, why = at, reason
        hit = _MARKER.search(view, at + 1)
        at = hit.start() if hit else len(view)
    if bad >= 0:
        yield Gap(bad, len(view) - bad, why)


def salvage(data: bytes) -> tuple[list[Record], list[Gap]]:
    """All of scan at once, for archives that fit in memory with their blocks."""
    found = list(scan(data))
    return [x for x in found if isinstance(x, Record)], [x for x in found if isinstance(x, Gap)]


_ROW = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inside", pa.int64()), ("inside_length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string())]
    + [("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("checked", pa.bool_()), ("payload", pa.binary())]
)
_ROW_SQL = "path string, offset long, length long, inside long, inside_length long, gap string, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, checked boolean, payload binary"
#: Bytes of payload and rows in a batch that leaves the reader.
_BATCH, _ROWS = 4 << 20, 512


def _row(path: str, r: Record | Gap, with_payload: bool) -> dict:
    row = dict.fromkeys(_ROW.names) | {"path": path, "offset": r.offset, "length": r.length}
    if r.inside:
        row |= {"inside": r.inside[0], "inside_length": r.inside[1]}
    if isinstance(r, Gap):
        return row | {"gap": r.reason}
    h = r.headers
    head, split, payload = r.block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", r.block)
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = len(payload)
    if h.get("warc-type") == "revisit":
        size = next((int(x.partition(b":")[2]) for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:") and x.partition(b":")[2].strip().isdigit()), None)
    else:
        digest = sha1_base32(payload)
    row |= {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to")}
    return row | {"payload_bytes": size, "payload_digest": digest, "checked": r.checked, "payload": payload if with_payload else None}


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record salvaged from the archives under `path`, and one with `gap` set (the reason) for each quarantined gap.

    offset and length are bytes of the archive (length 0: from a member that breaks), inside and
    inside_length those of the inflated gzip member.  checked: the block digest was there and right.
    An archive is a task's unit and comes through Spark's binary reader, so any store that Spark
    opens will do; its bytes are held once by the reader and once by the task (2 GiB at most, by
    Spark's own limit), what it inflates to only record by record.  An empty folder gives no rows;
    an empty archive none either.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for r in scan(data.as_buffer()):
                    rows.append(_row(name, r, with_payload))
                    size += len(rows[-1]["payload"] or b"")
                    if len(rows) >= _ROWS or size >= _BATCH:
                        yield from pa.Table.from_pylist(rows, schema=_ROW).to_batches()
                        rows, size = [], 0
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=_ROW).to_batches()

    return files.select("path", "content").mapInArrow(run, _ROW_SQL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read them back (other columns are ignored, whatever their names): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch.place(spark, "warc")
    write(pages, path)
    rows = read(spark, path, with_payload=False).where(F.col("gap").isNull())

    def number(c: str):
        return F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")

    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
