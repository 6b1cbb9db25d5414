"""WARC archives with a two-level capture index (operator 2).

Writing: a gzip member for each record, response or revisit.  A revisit has the headers of its
payload and the digest, and refers to the record of equal payload with the largest id.

Index: a line for each capture, keyed by the URL with its host reversed, sorted; runs of lines are
compressed into blocks, and each index file ends with its sparse directory, the first key of each
block.  The driver knows the first and last key of each index file only.

Reading: a key goes to the index files whose range holds it, is found there by binary search in the
directory, and its blocks are read; captures then go to their archive, sorted by offset, and
neighbouring ranges are read at once.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, text_column, written
from .files import Reader, Writer

#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 64 << 20
#: Lines in an index block, and captures in an index file, about.
BLOCK_LINES, FILE_CAPTURES = 512, 1 << 16
#: Index files at most, as the driver knows where each begins and ends; beyond, files hold more captures.
MOST_FILES = 1 << 14
#: Bytes that one range read of an archive takes at most, and gap between records that it bridges.
RANGE_BYTES, GAP_BYTES = 8 << 20, 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, url string, record_type string, digest string, archive string, offset long, length long"
INDEX = "part int, url string, directory_at long, directory_length long, first string, last string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def capture_key(url: str | None) -> str:
    """The URL with its host's labels reversed, lower-cased: com,example,m)/path?query. White space
    and control characters are percent-encoded; what isn't a URL is kept after '~'."""
    text = quote(url or "", safe="".join(chr(c) for c in range(33, 127)))
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        host = ""
    if not host:
        return "~" + text
    query = "?" + parts.query if parts.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + query


def name_of(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def id_of(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A record, uncompressed. A revisit's block has the payload's headers only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name_of(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=''.join(chr(c) for c in range(33, 127)))}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name_of(refers_to)}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in fields}, rest


def parsed(data: bytes) -> dict:
    """What a record says; a response's digest and size are those of the payload as read."""
    fields, rest = headers(data)
    block = rest[: int(fields["content-length"])]
    http, payload = headers(block)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if (found := sha1_base32(payload)) != digest:
            raise ValueError(f"{fields['warc-record-id']}: digest {found}, not {digest}")
    else:
        size, payload = int(http["content-length"]), None
    return {"page_id": id_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": id_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        for batch in batches:
            for page_id, url, html, last in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "last")), strict=True):
                out = out or Writer(folder, ".warc.gz")
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest, revisit = sha1_base32(payload), last is not None and page_id is not None and page_id != last
                data = gzip_member(record(page_id, url, payload, digest, last if revisit else None, revisit, date))
                rows.append({"key": capture_key(url), "page_id": page_id, "url": url, "record_type": "revisit" if revisit else "response", "digest": digest, "archive": out.url, "offset": out.write(data), "length": len(data)})
                if out.position >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pylist(rows, _CAPTURE)
                    out, rows = None, []
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, _CAPTURE)

    return run


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives in folder, a URL.
    Returns the captures, CAPTURE.

    Null html is an empty payload. Of payloads of at least least_bytes bytes that are equal, records
    with the largest page_id are responses, all others revisit it; the rest are responses, as are
    rows with a null page_id. Rows that repeat are written as often. No rows give no captures.
    """
    rows = text_column(pages, "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("sha1", F.sha1(F.coalesce("html", F.lit(""))))
    wide = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    again = written(rows.filter(wide).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("sha1", "last"), "repeated-payloads")
    rows = rows.join(again, "sha1", "left").select("page_id", "url", "html", F.when(wide, F.col("last")).alias("last"))
    return written(rows.mapInArrow(write_archives(folder, date), CAPTURE), "captures")


def write_index_file(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, lines, directory, last = None, [], [], ""

        def flush() -> None:
            block = zlib.compress("\n".join(x for _, x in lines).encode(), 6)
            directory.append([lines[0][0], out.write(block), len(block)])
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                out = out or Writer(folder, ".cdx")
                last = row.pop("key")
                lines.append((last, f"{last} {json.dumps(row)}"))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode())
            at = out.write(packed)
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "url": out.url, "directory_at": at, "directory_length": len(packed), "first": directory[0][0], "last": last}], pa.schema([("part", pa.int32()), ("url", pa.string()), ("directory_at", pa.int64()), ("directory_length", pa.int64()), ("first", pa.string()), ("last", pa.string())]))

    return run


def write_index(captures: DataFrame, folder: str, file_captures: int = FILE_CAPTURES) -> DataFrame:
    """Writes the index of captures to folder, a URL; returns its files, INDEX, in key order."""
    files = max(1, min(MOST_FILES, -(-captures.count() // file_captures)))
    order = ["key", "page_id", "archive", "offset"]
    return written(captures.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(write_index_file(folder), INDEX), "index-files")


class IndexFile:
    def __init__(self, url: str, at: int, length: int) -> None:
        self.file = Reader(url)
        self.directory = json.loads(zlib.decompress(self.file.read(at, length)))
        self.firsts = [x[0] for x in self.directory]
        self.number, self.lines, self.keys = -1, [], []

    def block(self, number: int) -> None:
        if number != self.number:
            _, at, length = self.directory[number]
            self.lines = zlib.decompress(self.file.read(at, length)).decode().split("\n")
            self.keys, self.number = [x.partition(" ")[0] for x in self.lines], number

    def find(self, key: str) -> Iterator[dict]:
        """The captures under key: its first block by binary search, and on while blocks hold it."""
        number = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while number < len(self.firsts) and self.firsts[number] <= key:
            self.block(number)
            for k in range(bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)):
                yield {"key": key, **json.loads(self.lines[k].partition(" ")[2])}
            number += 1


def look_up(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The captures, CAPTURE, of each distinct url in urls; a null is looked up as an empty one.

    index has at most MOST_FILES rows; the driver takes those rows' bounds.
    """
    files = sorted(index.collect(), key=lambda r: r["part"])
    firsts, lasts = [r["first"] for r in files], [r["last"] for r in files]
    places = {r["part"]: (r["url"], r["directory_at"], r["directory_length"]) for r in files}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sorted({capture_key(u) for u in batch.column("url").to_pylist()})
            found = [(files[k]["part"], key) for key in keys for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.record_batch([pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["part", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file = None, None
        for batch in batches:
            rows = []
            for number, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if number != part:
                    part, file = number, IndexFile(*places[number])
                rows += file.find(key)
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_pylist(rows, _CAPTURE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _CAPTURE)

    asked = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(route, "part int, key string").distinct()
    return asked.repartition(max(1, len(files)), "part").sortWithinPartitions("part", "key").mapInArrow(search, CAPTURE)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of captures that come sorted by archive and offset, by merged range reads."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    archive, file = None, None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
        begin = 0
        while begin < len(rows):
            end, (own, at, _) = begin + 1, rows[begin]
            stop = at + rows[begin][2]
            while end < len(rows) and rows[end][0] == own and rows[end][1] <= stop + GAP_BYTES and rows[end][1] + rows[end][2] - at <= RANGE_BYTES:
                stop = max(stop, rows[end][1] + rows[end][2])
                end += 1
            if own != archive:
                archive, file = own, Reader(own)
            data = file.read(at, stop - at)
            yield pa.RecordBatch.from_pylist([parsed(zlib.decompress(data[offset - at : offset - at + length], 31)) for _, offset, length in rows[begin:end]], schema)
            begin = end


def read_records(captures: DataFrame) -> DataFrame:
    """The records, RECORD, of captures. payload is null for a revisit."""
    archives = max(1, captures.select("archive").distinct().count())
    return captures.select("archive", "offset", "length").repartition(archives, "archive").sortWithinPartitions("archive", "offset").mapInArrow(fetch, RECORD)


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")
    index = write_index(write_pages(pages, folder), folder)
    captures = written(look_up(pages, index), "found-captures")
    return read_records(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with rows as (select page_id, encode(coalesce(html, '')) as payload, sha1(encode(coalesce(html, ''))) as digest from pages),
last as (select digest, max(page_id) as last from rows group by digest)
select page_id, octet_length(payload)::bigint as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((instr('0123456789abcdef', substr(digest, 1 + (5 * i) // 4, 1)) - 1) * 16
       + greatest(instr('0123456789abcdef', substr(digest || '0', 2 + (5 * i) // 4, 1)) - 1, 0)) // (1 << (3 - (5 * i) % 4))) % 32 + 1, 1), '' order by i)
   from range(32) as t(i)) as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to
from rows join last using (digest)
"""
