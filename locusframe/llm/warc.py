"""WARC archives: records of pages with revisits for equal payloads, and a reader that salvages damaged archives.

Spark's text writer puts the archive out, each row a record without its last line feed, so any store will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, shared_path, slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: Payload of an archive, about; an archive is read by one task.
ARCHIVE_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head only, whose Content-Length is that of the full payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError if any check fails."""
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise ValueError("header does not end")
    head = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            raise ValueError("bad header line")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not head.get("warc-type") or not head.get("warc-record-id"):
        raise ValueError("a field that each record has is missing")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = stop + 4
    end = start + int(head["content-length"])
    block = data[start:end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if head.get("warc-type") == "response" and "warc-payload-digest" in head and head["warc-payload-digest"] != "sha1:" + digest(payload if sep else block):
        raise ValueError("payload digest differs")
    return head, block, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``at``; of a damaged or cut one what could be read, and why it ended."""
    z, view, out = zlib.decompressobj(31), memoryview(data), []
    while at < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(view[at : at + 65536]))
        except zlib.error as e:
            for k in range(at, at + 65536):
                try:
                    out.append(before.decompress(view[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), at, f"member is damaged: {e}"
        at = min(len(data), at + 65536)
    return b"".join(out), at - len(z.unused_data), "" if z.eof else "member is cut off"


def _members(data: bytes):
    """(start, end, content, why): gzip members in order. A damaged one, or bytes that are none, end at the next magic that opens a whole member, or one whose content begins as a record."""
    at = 0
    while at < len(data):
        body, end, why = _inflate(data, at) if data.startswith(_MEMBER, at) else (b"", at, "no gzip member")
        if why:
            end = data.find(_MEMBER, at + 1)
            while end >= 0:
                found, _, bad = _inflate(data, end)
                if not bad or _VERSION.match(found):
                    break
                end = data.find(_MEMBER, end + 1)
            end = len(data) if end < 0 else end
        yield at, end, body, why
        at = end


def salvage(data: bytes, base: int = 0):
    """Records and gaps of an archive, plain or gzip, in order.

    Yields ("record", start, end, headers, block) and ("gap", start, end, reason, None); offsets are bytes of
    the file (of gzip archives those of the member). After a failed check the search goes on at the next
    version line whose record passes all checks, or the next gzip member; the bytes between are a gap. A damaged member is a gap,
    but records in what could be read of it are given too, if they pass all checks.
    """
    if data.startswith(_MEMBER) or (_MEMBER in data and not _VERSION.search(data)):
        for start, end, body, why in _members(data):
            if why:
                yield "gap", base + start, base + end, why, None
            for kind, _, _, x, block in salvage(body):
                if kind == "record" or not why:
                    yield kind, base + start, base + end, x, block
        return
    at = 0
    while at < len(data):
        try:
            head, block, end = _parse(data, at)
            yield "record", base + at, base + end, head, block
            at = end
            continue
        except ValueError as e:
            why = str(e)
        nxt = at
        while m := _VERSION.search(data, nxt + 1):
            nxt = m.start()
            try:
                _parse(data, nxt)
                break
            except ValueError:
                continue
        end = nxt if m else len(data)
        yield "gap", base + at, base + end, why, None
        at = end


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: null for the row of the largest page_id among equal payloads, else that page_id.

    Payloads are told apart by SHA-1 of the UTF-8. The largest page of each digest comes from an aggregate
    with a map-side part; only (digest, page) goes through it, and the join back is an ordinary equi-join
    whose hot digests adaptive execution can split. Null page_ids count as smaller than all others; a group
    of null ids alone has responses only. Rows with the largest page_id are responses, all of them if repeated.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    largest = keyed.groupBy("sha").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "largest")
    joined = keyed.join(largest, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def _member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, as the top byte of a length below 16 MB is; an empty member follows a longer one."""
    made = gzip.compress(record, 6, mtime=0)
    return made if made[-1] == 0 else made + gzip.compress(b"", 6, mtime=0)


def write_warc(pages: DataFrame, out: str, member_gzip: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row of ``pages`` (page_id, url, html) to archives below ``out``.

    Each task fills one archive after the other, in folders by their number, none larger than ``archive_bytes`` unless it is a single record.

    ``member_gzip`` writes each record as a gzip member of its own; their last byte, zero, is the line separator of the
    text writer, so nothing stands between members.
    """

    def run(batches):
        roll = size = 0
        for b in slices(batches, 256):
            ids, urls, refs = (b.column(i).to_pylist() for i in (0, 1, 3))
            made, rolls = [], []
            for x in zip(ids, urls, as_bytes(b.column(2)), refs, strict=True):
                member = _member(record(*x)) if member_gzip else record(*x)
                if size and size + len(member) > archive_bytes:
                    roll, size = roll + 1, 0
                size += len(member)
                made.append(member[:-1])
                rolls.append(roll)
            yield pa.RecordBatch.from_arrays([pa.array(rolls, pa.int32()), pa.array(made, pa.binary())], names=["roll", "record"])

    lines = with_originals(pages).mapInArrow(run, "roll int, record binary").select("roll", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("roll").option("lineSep", "\x00" if member_gzip else "\n").text(out)


_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def scan_warc(spark, path: str) -> DataFrame:
    """Records and gaps of the archives below ``path``.

    kind (record, gap), file, start, stop, reason (of gaps), record_id, record_type, url, refers_to,
    payload_bytes (of the full payload), payload_digest and payload (null for revisits). A file is read by one task.
    """
    schema = "kind string, file string, start long, stop long, reason string, record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def rows(name: str, data: bytes):
        for kind, start, stop, x, block in salvage(data):
            if kind == "gap":
                yield kind, name, start, stop, x, None, None, None, None, None, None, None
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            revisit = x.get("warc-type") == "revisit"
            said = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
            n = int(said[1]) if said and revisit else len(payload)
            yield kind, name, start, stop, None, x.get("warc-record-id"), x.get("warc-type"), x.get("warc-target-uri"), x.get("warc-refers-to"), n, x.get("warc-payload-digest", "").removeprefix("sha1:"), None if revisit else payload

    def run(batches):
        for b in slices(batches, 1):
            found = []
            for row in rows(b.column(0)[0].as_py(), b.column(1)[0].as_py() or b""):
                found.append(row)
                if len(found) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return spark.read.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def read_warc(spark, path: str) -> DataFrame:
    """The valid records of ``scan_warc``."""
    return scan_warc(spark, path).filter("kind = 'record'")


def quarantine(spark, path: str) -> DataFrame:
    """The log of byte ranges that hold no valid record: file, start, stop, reason."""
    return scan_warc(spark, path).filter("kind = 'gap'").select("file", "start", "stop", "reason")


def page_archive(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row for each row, repeated ones too. A null html is an empty payload; a null page_id comes back null, and refers to
    the largest page_id of its payload, or is a response where that is null too. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    out = out or shared_path(spark, "warc")
    write_warc(pages, out, member_gzip=True)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, out).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
