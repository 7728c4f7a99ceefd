"""WARC archives: a writer with revisit records for equal payloads, and a reader that salvages damaged files.

Archives are written by Spark's own committed file writer, so a lost executor or a repeated task leaves no partial
file. Each record is a gzip member of its own; an empty member, which adds nothing to the stream, ends each line
of the writer. An archive is closed after UNITS units of UNIT bytes of pages, or one page more, so that a reader can
take it whole; archives of others may have what a binary column holds, 2 GB.

The reader checks each member (header, checksum, length) and each record (version line, content length, block digest,
payload digest). After a failed check it searches for the next member that opens with a version line, or the next
version line in plain archives, goes on there, and logs the bytes between as a gap. Inside a member it does the same:
records before and after a bad one are recovered, whether many records share a member or the whole archive is one, and
a gap names the bytes of the member's content. What was inflated before a damaged place, a cut or a wrong checksum is
kept as far as its records prove themselves by a digest.

Defined results: a null page has an empty payload; a null url writes no target. Rows with equal ids are each
written. Of equal payloads of MIN_BYTES or more, the row with the largest id is the response; rows that tie on the
largest id are responses each, and so are rows without an id where no other row has one. `write` and `round_trip` run
jobs when they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import finished, groups, materialize, shared_dir

MIN_BYTES = 1000
#: Bytes of pages that a row of the writer stands for, and rows of an archive.
UNIT, UNITS = 4_000_000, 64
DATE = "2024-01-01T00:00:00Z"
#: An empty gzip member.
EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
URI = "urn:x-page:"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record with its end: a response with the payload, or a revisit with the headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URI}{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: " + _sha1(payload))
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <{URI}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["WARC-Block-Digest: " + _sha1(block), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Broken(ValueError):
    pass


def _deflated(data: memoryview, at: int) -> int:
    """Where the deflate stream of a gzip member begins, -1 if its header is broken."""
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return -1
    flags, p = data[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(data[p : p + 2], "little")
    for flag in (8, 16):  # name and comment
        if flags & flag:
            while p < len(data) and data[p]:
                p += 1
            p += 1
    return p + 2 if flags & 2 else p


def _inflate(data: memoryview, at: int, step: int = 1 << 15) -> tuple[bytes, int | None, str]:
    """The content of the gzip member at a position, the end of what is surely its own (None if unknown), and the failed check
    ("" for none). Input is given in steps, so that what is left over is never copied whole; after an error in the stream
    the last step is given again bit by bit, for what can be read before it."""
    start = _deflated(data, at)
    if start < 0:
        return b"", None, "member: header"
    d, out, fault, p = zlib.decompressobj(-15), [], "", start
    while not d.eof and not fault:
        part = data[p : p + step]
        if not len(part):
            return b"".join(out), None, "member: ends early"
        try:
            out.append(d.decompress(part))
            p += len(part) - len(d.unused_data)
        except zlib.error as e:
            fault = f"member: {e}"
    if fault:
        d = zlib.decompressobj(-15)
        out = [d.decompress(data[k : min(k + step, p)]) for k in range(start, p, step)]
        try:
            for k in range(p, min(p + step, len(data))):
                out.append(d.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out), None, fault
    content = b"".join(out)
    if p + 8 > len(data):
        return content, p, "member: ends early"
    if int.from_bytes(data[p : p + 4], "little") != zlib.crc32(content) or int.from_bytes(data[p + 4 : p + 8], "little") != len(content) & 0xFFFFFFFF:
        return content, p, "member: checksum"
    return content, p + 8, ""


def _parse(data: memoryview | bytes, at: int = 0, proof: bool = False) -> tuple[dict, int]:
    """The record at a position, and its end. proof: without a digest that holds, it is broken."""
    view = memoryview(data)
    if not VERSION.match(view, at):
        raise Broken("no version line")
    window = 1 << 14
    end = -1
    while end < 0:
        end = bytes(view[at : at + window]).find(b"\r\n\r\n")
        if end < 0 and at + window >= len(view):
            raise Broken("the header has no end")
        window *= 4
    lines = bytes(view[at : at + end]).decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not head.get("content-length", "").isdigit():
        raise Broken("no content length")
    if not head.get("warc-type") or not head.get("warc-record-id"):
        raise Broken("a required field is missing")
    start = at + end + 4
    stop = start + int(head["content-length"])
    if stop > len(view):
        raise Broken("the block ends early")
    block = bytes(view[start:stop])
    if bytes(view[stop : stop + 4]) != b"\r\n\r\n":
        raise Broken("the record has no end")
    if "warc-block-digest" in head and head["warc-block-digest"].startswith("sha1:") and head["warc-block-digest"] != _sha1(block):
        raise Broken("block digest")
    http, payload, length = {}, block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        opening, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in opening.decode("latin-1").split("\r\n")[1:])}
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    digest = head.get("warc-payload-digest", "")
    kind = head.get("warc-type", "")
    if kind != "revisit" and digest.startswith("sha1:") and digest != _sha1(payload):
        raise Broken("payload digest")
    if proof and not head.get("warc-block-digest", "" if kind == "revisit" else digest).startswith("sha1:"):
        raise Broken("no digest in a damaged member")
    return {"head": head, "type": kind, "payload": payload if kind != "revisit" else None, "length": length}, stop + 4


Gap = tuple[int, int, str, int | None, int | None]


def _records(content: bytes, proof: bool) -> Iterator[tuple[str, object]]:
    """("record", fields) and ("gap", (start, end, reason)) of a member's content."""
    view, at, lost, why = memoryview(content), 0, None, ""
    while at < len(content):
        try:
            fields, after = _parse(view, at, proof)
        except Broken as e:
            if lost is None:
                lost, why = at, str(e)
            line = VERSION.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if lost is not None:
            yield "gap", (lost, at, why)
            lost = None
        yield "record", fields
        at = after
    if lost is not None:
        yield "gap", (lost, len(content), why)


class _Next:
    """The next place at or after a position where something stands; each byte is searched once."""

    def __init__(self, find):
        self.find, self.at = find, -1

    def __call__(self, position: int) -> int:
        if self.at < position:
            self.at = self.find(position)
        return self.at


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """("record", fields) and ("gap", (start, end, reason, inner start, inner end)) of an archive, in order of position. The inner
    positions are those in a member's content; an inner end of None stands for all after the inner start. A record's offset
    is that of its member."""
    view, n, at = memoryview(data), len(data), 0
    lost: tuple[int, str, int | None] | None = None

    def line(position: int) -> int:
        m = VERSION.search(data, position)
        return m.start() if m else n

    def opening(position: int) -> int:
        k = data.find(MEMBER, position)
        return k if k >= 0 else n

    next_line, next_member = _Next(line), _Next(opening)
    while at < n:
        start, found, end, fault = at, [], None, ""
        if data.startswith(MEMBER, at):
            content, end, fault = _inflate(view, at)
            found = list(_records(content, bool(fault)))
            some = any(kind == "record" for kind, _ in found)
            if not some and (fault or content or lost is not None):  # inside a gap, an empty member alone proves nothing
                fault = fault or (found[0][1][2] if found else lost[1])
                found = []
        else:
            try:
                fields, end = _parse(view, at)
                found = [("record", fields)]
            except Broken as e:
                fault = str(e)
        if (found or not fault) and lost is not None:
            yield "gap", (lost[0], start, lost[1], lost[2], None)
            lost = None
        rest = None
        for k, (kind, x) in enumerate(found):
            if kind == "record":
                yield "record", x | {"offset": start}
            elif fault and k == len(found) - 1:  # the damage goes on beyond the content
                rest = x[0]
            else:
                yield "gap", (start, end if end is not None else start, x[2], x[0], x[1])
        if not fault:
            at = end
            continue
        if lost is None:
            lost = (start, fault, (rest if rest is not None else len(content)) if found else None)
        after = end if end is not None else start + 1
        at = min(next_line(after), next_member(after))
    if lost is not None:
        yield "gap", (lost[0], n, lost[1], lost[2], None)


def first_of_equals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """_digest and _first (largest page_id) of payloads that several rows have. Counted before anything is joined."""
    html = F.coalesce("html", F.lit(""))
    long = pages.select("page_id", F.sha1(html.cast("binary")).alias("_digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= min_bytes)
    return long.groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1").select("_digest", "_first")


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, unit: int = UNIT, units: int = UNITS) -> None:
    """Writes archives of the pages (page_id, url, html) to a folder of any file system that Spark writes. An archive holds at
    most `units` times `unit` bytes of pages and the page that passes this bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(2), unit):
                rows = zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4)), strict=True)
                members = [member(record(p, url, (html or "").encode(), to)) for p, url, html, to in rows]
                data = b"".join(members)
                # the writer counts rows: a page of many units takes the places of as many
                yield pa.RecordBatch.from_arrays([pa.array([data] + [EMPTY] * (len(data) // unit), pa.binary())], ["members"])

    firsts = materialize(first_of_equals(pages, min_bytes))
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("_digest")).join(firsts, "_digest", "left")
    to = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).cast("long")
    members = known.select("page_id", "url", "html", to.alias("refers_to")).mapInArrow(run, "members binary")
    # text lines are written as their bytes; a row's line end is an empty member
    members.select(F.col("members").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", units).text(path)


READ = "archive string, start long, stop long, error string, inner_start long, inner_stop long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of all archives in a folder: records (error is null), and gaps with their bytes, the failed check, and where a gap
    lies inside a member, the bytes of its content."""

    def ident(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(URI)
        return int(tail) if re.fullmatch(r"-?\d+", tail) else None

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for kind, x in salvage(data):
            if kind == "gap":
                yield (name, *x, None, None, None, None, None, None, None)
                continue
            head, payload = x["head"], x["payload"]
            if payload is not None:
                digest = hashlib.sha1(payload).hexdigest()
            else:
                said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                digest = base64.b32decode(said).hex() if re.fullmatch(r"[A-Z2-7]{32}", said) else None
            yield name, x["offset"], None, None, None, None, ident(head.get("warc-record-id")), head.get("warc-target-uri"), x["type"], ident(head.get("warc-refers-to")), x["length"], digest, payload if with_payload else None

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in READ.split(", ")), strict=True)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held, size = [], 0
                for row in rows(b.column(0)[i].as_py(), b.column(1)[i].as_buffer().to_pybytes()):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4_000_000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder, reads them back, without payloads, and removes the archives."""

    def there_and_back() -> DataFrame:
        path = shared_dir(pages.sparkSession)
        write(pages, path, min_bytes)
        return read(pages.sparkSession, path, with_payload=False).filter("error IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

    return finished(pages.sparkSession, there_and_back)
