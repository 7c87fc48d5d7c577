"""WARC archives: writing with segments, revisits and chunked transfer framing; reading with reassembly.

``write`` makes one record per page. Of pages with equal payloads of at least ``least`` bytes the smallest
id gets a response record and the others revisit records that name it. A response is an HTTP message whose
body is in chunked transfer framing. A message over ``segment`` bytes is split over a first record and
continuation records (WARC-Segment-Origin-ID, WARC-Segment-Number, and on the last one
WARC-Segment-Total-Length), which may lie in any file. Every record is a gzip member of its own, so that
readers can seek to it, and every file starts with a warcinfo record. A member ends with the highest byte of
its record's length, which is zero below 16 MB: that byte is the line separator of Spark's text sink. So
records are rows, files are committed by Spark's own protocol in any store, and no task holds more than a
batch of records. (The sink names the files part-*.txt.)

``read`` parses archives, plain or of gzip members of any number of records. Whole records are decoded where
they are read. Segments are dealt by origin, sorted by number and decoded as a stream: numbers must run from
1 without a gap, the lengths must sum to the total, the chunked framing must end properly and the digest must
fit; nothing is held but the state of the decoder and, if asked for, the payload. What is damaged gives a row
with an error, and reading goes on at the next record or member that can be made out.

Defined results: a null html is an empty payload; a null url is left out; repeated rows of equal page_id, url
and html are a record each, all but one of them revisits that need no payload and are made from their number;
rows of equal page_id and different html are pages of their own; a null page_id is never referred to unless no
other page has the payload; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import small

SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Bytes of records to a file, before compression; a reader holds one file.
FILE_BYTES = 16 << 20
LEAST = 0
#: Repeated rows that one task makes of their number.
REPEATS = 1000
_END = b"\r\n"
_CRLF = "\r\n"
_MAGIC = b"\x1f\x8b\x08"
_PIECE = 64 << 10


def _uuid(*parts: Column) -> Column:
    """A record id from a digest of the parts."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(c), c) for at in range(0, len(payload), size) for c in (payload[at : at + size],)]
    return b"".join(out) + b"0\r\n\r\n"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + _END


def records(page_id, url: str | None, payload: bytes, record_id: str, refers_to: str | None, refers_page, segment: int = SEGMENT, date: str = "2024-01-01T00:00:00Z", known: tuple[str, int] | None = None) -> list[bytes]:
    """The records of a page, without the two line ends after each. ``known`` has the digest and the length of the
    payload where they are known already, as a revisit needs no more of it."""
    digest_, length = known or (digest(payload), len(payload))
    common_fields = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None), ("WARC-Date", date), ("X-Page-ID", page_id)]
    own = [("WARC-Payload-Digest", f"sha1:{digest_}"), ("X-Payload-Length", length)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common_fields, *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to), ("X-Refers-To-Page-ID", refers_page), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
        return [_header(fields) + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = []
    for i, part in enumerate(parts):
        number = [("WARC-Segment-Number", i + 1)] if len(parts) > 1 else []
        last = [("WARC-Segment-Total-Length", len(block))] if i and i + 1 == len(parts) else []
        kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(hashlib.md5(f"{record_id}{i}".encode()).hexdigest())), ("WARC-Segment-Origin-ID", record_id)] if i else [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *own]
        out.append(_header([*kind, *common_fields, *number, *last, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(part))]) + part)
    return out


def _urn(h: str) -> str:
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def info(name: str, date: str) -> bytes:
    """The record that a file starts with."""
    block = b"software: bracken\r\nformat: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(hashlib.md5(f"{name} {date}".encode()).hexdigest())), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block


def member(record: bytes) -> bytes:
    """The record and its two line ends as a gzip member, without the member's last byte, which is zero."""
    z = zlib.compressobj(wbits=31)
    return (z.compress(record + b"\r\n\r\n") + z.flush())[:-1]


def write(pages: DataFrame, to: str, least: int = LEAST, segment: int = SEGMENT, date: str | None = None) -> None:
    """Write the archives of all pages (page_id, url, html) to a folder that all executors share. ``date`` is that of
    the records; without one it is now."""
    if segment > 8 << 20:
        raise ValueError("a segment has at most 8 MB")
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("record_id", _uuid(F.col("page_id"), F.col("url"), F.col("sha")))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    known = common.shared_table(keyed.select("sha", "record_id", "page_id", "url", "n"), "page-digests")
    total, count = known.agg(F.sum("n"), F.count("*")).first()
    groups = known.filter(F.col("n") >= least).groupBy(F.col("sha").alias("g_sha")).agg(F.count("*").alias("k"), F.min(place).alias("first")).filter("k > 1").select("g_sha", "first")
    groups = common.shared_table(groups, "page-copies")
    again = known.filter(F.col("n") >= least).groupBy("record_id").agg(F.count("*").alias("k"), F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("sha").alias("sha"), F.first("n").alias("n")).filter("k > 1")
    again = common.shared_table(again, "page-repeats")

    joined = keyed.join(small(groups), keyed["sha"] == groups["g_sha"], "left")
    is_first = F.col("first").isNull() | (F.col("record_id") == F.col("first.record_id"))
    refers = [F.when(~is_first, F.col("first.record_id")).alias("refers_to"), F.when(~is_first, F.col("first.page_id")).alias("refers_page")]
    # equal rows below ``least`` are responses each and need ids of their own
    own_id = F.when(F.col("n") < least, _uuid(F.col("record_id"), F.monotonically_increasing_id())).otherwise(F.col("record_id"))
    joined = joined.select("page_id", "url", F.when(is_first, F.col("html")).alias("html"), "record_id", own_id.alias("own_id"), *refers, "sha", "n")
    if not again.isEmpty():  # of repeated rows one as it is, and as many revisits as there are more
        once = joined.join(small(again.select(F.col("record_id").alias("again"))), joined["record_id"] == F.col("again"), "left_anti")
        one = joined.join(small(again.select(F.col("record_id").alias("again"))), joined["record_id"] == F.col("again"), "left_semi").dropDuplicates(["record_id"])
        blocks = again.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 2) / REPEATS)))).repartition("record_id", "block")
        more = blocks.withColumn("i", F.explode(F.sequence(F.col("block") * REPEATS + 1, F.least((F.col("block") + 1) * REPEATS, F.col("k") - 1))))
        more = more.join(small(groups), more["sha"] == groups["g_sha"])
        more = more.select("page_id", "url", F.lit(None).cast("string").alias("html"), "record_id", _uuid(F.col("record_id"), F.col("i")).alias("own_id"), F.col("first.record_id").alias("refers_to"), F.col("first.page_id").alias("refers_page"), "sha", "n")
        joined = once.unionByName(one).unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = []
                for r in b.slice(at, 256).to_pylist():
                    known = base64.b32encode(bytes.fromhex(r["sha"])).decode(), r["n"]
                    found += records(r["page_id"], r["url"], (r["html"] or "").encode(), r["own_id"], r["refers_to"], r["refers_page"], segment, date, known)
                yield pa.RecordBatch.from_arrays([pa.array(map(member, found), pa.binary())], ["record"])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array([member(info(f"{to} {TaskContext.get().partitionId()}", date))], pa.binary())], ["record"])
            yield b

    files = max(1, -(-int((total or 0) + 800 * count) // FILE_BYTES))
    made = joined.mapInArrow(run, "record binary").repartition(files, F.xxhash64("record")).mapInArrow(started, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").text(to)


def unpacked(archive: bytes) -> tuple[bytes, list[str]]:
    """The content of an archive of gzip members, or of a plain one; and what is wrong with members."""
    if not archive.startswith(_MAGIC):
        return archive, []
    out, wrong, at, whole = [], [], 0, memoryview(archive)
    while at < len(archive):
        start, z = at, zlib.decompressobj(31)
        try:
            while not z.eof and at < len(archive):
                piece = whole[at : at + _PIECE]
                out.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
            if not z.eof:
                wrong.append(f"the member at byte {start} is cut short")
        except zlib.error as e:
            wrong.append(f"the member at byte {start}: {e}")
            at = archive.find(_MAGIC, start + 1)
            if at < 0:
                break
    return b"".join(out), wrong


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields in lower case, block, error) of each record, and of each place where there is none."""
    archive, wrong = unpacked(archive)
    for w in wrong:
        yield {}, b"", w
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at) if archive.startswith(b"WARC/", at) else -1
        error, fields, start, n = None, {}, 0, 0
        if end < 0:
            error = f"no record at byte {at}"
        else:
            lines = archive[at:end].decode("utf-8", "replace").split(_CRLF)[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = fields.get("content-length", "")
            start, n = end + 4, int(size) if re.fullmatch("[0-9]{1,15}", size) else -1
            if n < 0 or archive[start + n : start + n + 4] != b"\r\n\r\n":
                error = f"the record at byte {at} does not end where its length says"
        if error is None:
            yield fields, archive[start : start + n], None
            at = start + n + 4
        else:
            yield fields, b"", error
            at = archive.find(b"\r\n\r\nWARC/", at)
            at = len(archive) if at < 0 else at + 4


class Message:
    """An HTTP message that arrives in pieces: header, then a body that may be in chunked framing."""

    def __init__(self, hold: bool = False):
        self.sha, self.n, self.hold, self.held = hashlib.sha1(), 0, hold, []
        self.rest, self.state, self.left, self.framed = b"", "head", 0, False

    def _body(self, data: bytes) -> None:
        self.sha.update(data)
        self.n += len(data)
        if self.hold:
            self.held.append(data)

    def feed(self, data: bytes) -> None:
        data = self.rest + data
        self.rest, at = b"", 0
        while at < len(data):
            if self.state == "done":
                raise ValueError("data after the last chunk")
            if self.state == "plain":
                self._body(data[at:])
                return
            if self.state == "chunk":
                take = data[at : at + self.left]
                self._body(take)
                at, self.left = at + len(take), self.left - len(take)
                if not self.left:
                    self.state = "after"
                continue
            mark = b"\r\n\r\n" if self.state == "head" else b"\r\n"
            end = data.find(mark, at)
            if end < 0:
                self.rest = data[at:]
                return
            line, at = data[at:end], end + len(mark)
            if self.state == "head":
                self.framed = bool(re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", line))
                self.state = "size" if self.framed else "plain"
            elif self.state == "size":
                self.left = int(line.split(b";")[0], 16)
                self.state = "chunk" if self.left else "trailer"
            elif self.state == "after":
                if line:
                    raise ValueError("a chunk is longer than its size")
                self.state = "size"
            elif not line:  # the end of the trailer
                self.state = "done"

    def close(self) -> tuple[int, str]:
        if self.rest or self.state not in ("plain", "done"):
            raise ValueError("the message is cut short")
        return self.n, base64.b32encode(self.sha.digest()).decode()


_PARSED = "page_id string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, origin string, number int, total long, block binary, error string"
_NAMES = [x.split()[0] for x in _PARSED.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _PARSED.split(", ")])


def _finish(row: dict, message: Message, expected: str | None) -> dict:
    row["payload_bytes"], row["payload_digest"] = message.close()
    if message.hold:
        row["payload"] = b"".join(message.held)
    if expected and expected != f"sha1:{row['payload_digest']}":
        row["error"] = f"digest is {expected}"
    return row


def read(spark: SparkSession, at: str, payloads: bool = False) -> DataFrame:
    """(page_id, record_id, record_type, refers_to, payload_bytes, payload_digest, payload, error) of every page.

    refers_to is the page that a revisit refers to; its payload's length and digest are the record's own.
    A record that cannot be decoded has an error and null results.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for f, block, error in parse(content.as_py()):
                    kind = f.get("warc-type")
                    if not error and kind not in ("response", "revisit", "continuation"):
                        continue
                    row = {"page_id": f.get("x-page-id"), "record_id": f.get("warc-record-id"), "record_type": kind, "error": error}
                    try:
                        if error:
                            pass
                        elif kind == "revisit":
                            row |= {"refers_to": f.get("x-refers-to-page-id"), "payload_bytes": int(f["x-payload-length"]), "payload_digest": f["warc-payload-digest"].removeprefix("sha1:")}
                        elif "warc-segment-number" in f:
                            row |= {"origin": f.get("warc-segment-origin-id", row["record_id"]), "number": int(f["warc-segment-number"]), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "block": block, "payload_digest": f.get("warc-payload-digest")}
                            size += len(block)
                        else:
                            m = Message(payloads)
                            m.feed(block)
                            row = _finish(row, m, f.get("warc-payload-digest"))
                    except KeyError as e:
                        row["error"] = f"no field {e.args[0]}"
                    except ValueError as e:
                        row["error"] = str(e)
                    rows.append(row)
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    found = common.shared_table(files.mapInArrow(parsed, _PARSED), "records")

    def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, message, number, length, total, expected = None, None, 0, 0, None, None

        def done() -> dict:
            if not row.get("error"):
                try:
                    if total is None or total != length:
                        raise ValueError(f"segments have {length} bytes of {total}")
                    _finish(row, message, expected)
                except ValueError as e:
                    row["error"] = str(e)
            return row

        for b in batches:
            out = []
            for r in b.to_pylist():
                if row is None or r["origin"] != row["record_id"]:
                    if row is not None:
                        out.append(done())
                    row, message, number, length, total, expected = {"record_id": r["origin"], "record_type": "response", "page_id": r["page_id"]}, Message(payloads), 0, 0, None, r["payload_digest"]
                number, length, total = number + 1, length + len(r["block"]), r["total"]
                if r["number"] != number:
                    row.setdefault("error", f"segment {number} is missing")
                elif not row.get("error"):
                    try:
                        message.feed(r["block"])
                    except ValueError as e:
                        row["error"] = str(e)
            if out:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
        if row is not None:
            yield pa.RecordBatch.from_pylist([done()], _ARROW)

    segments = found.filter("origin IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(reassembled, _PARSED)
    return found.filter("origin IS NULL").unionByName(segments).drop("origin", "number", "total", "block")
