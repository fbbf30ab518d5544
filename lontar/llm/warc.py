"""WARC archives with an index first: write, then read selected records by coalesced byte ranges.

Writing: each task writes archives of its own to a shared folder (one gzip member per record) and returns an index
row per record: archive, offset, length, URL, page and payload digest. A file's name holds a random part, and only
the index of tasks that succeeded is kept, so lost or repeated tasks leave at most unused files. Which record holds a payload
is found from digests alone; pages stay where they lie while the digests that repeat are few enough to be sent to all tasks
(they are counted), beyond that the join to them deals pages out.

Reading: index rows (all, or any selection) are dealt by archive and range, sorted by offset, and neighbouring ranges
are read at once; every payload is checked against the digest in its header.

A null html is an empty payload. Of records with equal payloads of at least ``least_bytes``, those with the largest
page_id are responses (several only if that page_id is repeated), the others revisits of it; if a group has no page_id
at all, its records are responses. Null URLs become empty ones; line ends in URLs are percent-encoded. Empty tables
give no archive and an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lookup, read_table, small, stored, text_bytes, workspace

DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
#: Ranges at most so far apart are read at once, up to so many bytes; a task's unit of reading.
GAP_BYTES, READ_BYTES, SEGMENT_BYTES = 64 << 10, 8 << 20, 8 << 20
INDEX = "archive string, offset long, length long, url string, page_id long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_ID = "urn:lontar:page:"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. With refers_to it is a revisit, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{_ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A record as a row of RECORD; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = fields.get("WARC-Refers-To")
    if refers is None and (len(payload) != n or base32_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    name = fields["WARC-Record-ID"][1:-1]
    number = int(name.removeprefix(_ID)) if name.startswith(_ID) else None
    return number, fields["WARC-Target-URI"], n, digest, fields["WARC-Type"], refers and int(refers[1:-1].removeprefix(_ID)), payload if refers is None else None


def _writer(folder: str, archive_bytes: int, level: int):
    names = [c.split()[0] for c in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        stem, n, out, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, 0
        try:
            for batch in small(batches):
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{stem}-{n:04d}.warc.gz", 0
                        out, n = system.open_output_stream(f"{path}/{name}", compression=None), n + 1
                    page_id, newest = row["page_id"], row["newest"]
                    refers = None if newest is None or newest == page_id else newest
                    payload, url = row["payload"], row["url"] or ""
                    digest = base32_digest(payload)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, digest, refers)) + packer.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, page_id, digest, len(payload), "revisit" if refers is not None else "response", refers))
                    at += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return write


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as archives below folder; the index, stored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("_sha1", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.length("payload") >= least_bytes).groupBy("_sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    repeated = stored(groups.filter("n > 1").select("_sha1", "newest"), "warc-repeated")
    joined = lookup(rows, repeated, "_sha1").select("page_id", "url", "payload", "newest")
    return stored(joined.mapInArrow(_writer(folder, archive_bytes, level), INDEX), "warc-index")


def _reader(folder: str, payloads: bool):
    schema = _arrow(RECORD if payloads else RECORD.rpartition(", ")[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        open_name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            i = 0
            while i < len(rows):
                name, start, length = rows[i]
                end, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == name and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - start <= READ_BYTES:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if name != open_name:
                    if file is not None:
                        file.close()
                    open_name, file = name, system.open_input_file(f"{path}/{name}")
                chunk = file.read_at(end - start, start)
                found = [parse(zlib.decompress(chunk[a - start : a - start + n], 31)) for _, a, n in rows[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=False)], schema=schema)
                i = j
        if file is not None:
            file.close()

    return read


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of index name, as RECORD (without the payload if payloads is false)."""
    segment = F.floor(F.col("offset") / SEGMENT_BYTES)
    # As many tasks as segments: the index rows are few bytes, what they point to is not.
    tasks = -(-(index.agg(F.sum("length").alias("n")).first().n or 1) // SEGMENT_BYTES)
    narrow = index.select("archive", "offset", "length", segment.alias("_segment"))
    dealt = narrow.repartition(tasks, "archive", "_segment").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_reader(folder, payloads), RECORD if payloads else RECORD.rpartition(", ")[0])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "warc")
    index = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS newest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (j // 8), 10))::BIGINT >> (35 - 5 * (j % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN newest IS NULL OR page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN newest IS NULL OR page_id = newest THEN NULL ELSE newest END AS refers_to
FROM g
"""
