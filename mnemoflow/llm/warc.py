r"""WARC archives: a writer of gzip-member-per-record files and a splittable reader.

Writing. Each task writes one archive into a folder that driver and executors share; it goes under a name of its attempt and
is renamed when whole, so that a task that runs again after a lost executor replaces its file.

Reading. Spark lists the files (metadata only) and cuts them into byte ranges of SPLIT bytes; a task opens its range, scans
it for the gzip magic 1f 8b 08, and takes a candidate for a member if its deflated head decodes and holds a WARC version
line and a named record type. From the first member on it goes from member to member, and it owns the records whose member
starts inside its range, reading past the end for the last one. Bytes of which no member can be made are passed over.

Files are opened through pyarrow's file systems by URI, so any store that Spark and pyarrow share will do.

Defined cases: a null payload is written as empty; repeated rows give a record each, and so do rows that share a page_id, each
with its own payload; a row without a page_id refers to none and is referred to by none; empty input gives no records; an archive
without records is empty and gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save, with_least

SPLIT, LEVEL, HEAD, REVISIT_FROM = 16 << 20, 4, 4096, 1000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TYPE = re.compile(rb"\r\nWARC-Type: *([a-z]+)", re.I)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    digest = hashlib.sha1(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def write_archives(records: DataFrame, path: str) -> int:
    """Writes records (page_id, url, payload binary, refers_to) into archives under path; their number."""

    def run(batches):
        context = TaskContext.get()
        files, base = _filesystem(path)
        own = f"{base}/_attempt-{context.partitionId()}-{uuid.uuid4().hex}"
        n = 0
        with files.open_output_stream(own) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(record(row[0], row[1], row[2] or b"", row[3]))
                    n += 1
        files.move(own, f"{base}/part-{context.partitionId():06d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files, base = _filesystem(path)
    files.create_dir(base, recursive=True)
    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class _Window:
    """Bytes of a file from a position on, read in blocks; what lies before `base` is forgotten."""

    def __init__(self, file, at: int, size: int, block: int = 1 << 20):
        self.file, self.base, self.size, self.block, self.data = file, at, size, block, b""

    def upto(self, end: int) -> bytes:
        """The bytes from base to at least end, or to the end of the file."""
        have = self.base + len(self.data)
        if have < min(end, self.size):
            self.file.seek(have)
            self.data += self.file.read(min(self.size - have, max(end - have, self.block)))
        return self.data

    def forget(self, to: int) -> None:
        self.data, self.base = self.data[to - self.base :], to


def _is_member(data: bytes) -> bool:
    """Do these bytes begin a gzip member whose head is that of a WARC record?"""
    try:
        head = zlib.decompressobj(31).decompress(data, HEAD)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") and bool(_TYPE.search(head))


def read_split(file, size: int, start: int, end: int):
    """(offset, headers, block) of the records whose member starts in [start, end) of the file."""
    window, at = _Window(file, start, size), start
    while at < end:
        data = window.upto(at + HEAD)
        if not data.startswith(MAGIC, at - window.base) or not _is_member(data[at - window.base : at - window.base + HEAD]):
            found = window.upto(min(end + 2, size)).find(MAGIC, at + 1 - window.base)
            if found < 0 or window.base + found >= end:
                return
            at = window.base + found
            window.forget(at)
            continue
        inflate, raw, used = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof and used < size:
                data = window.upto(used + 1)
                raw.append(inflate.decompress(data[used - window.base :]))
                used = window.base + len(data)
        except zlib.error:
            at += 1
            continue
        if not inflate.eof:
            at += 1
            continue
        head, _, block = b"".join(raw).partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
        yield at, fields, block[: int(fields.get("content-length", len(block)))]
        at = used - len(inflate.unused_data)
        window.forget(at)


def read_archives(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, start, page_id, record_type, refers_to, digest, http_length, payload) of every record of the archives under path."""
    schema = "path string, start long, page_id long, record_type string, refers_to long, digest string, http_length long, payload binary"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length").where("length > 0")
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", s or "")) else None
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for uri, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, base = _filesystem(uri)
                rows = []
                with files.open_input_file(base) as file:
                    for at, fields, block in read_split(file, size, begin, min(size, begin + split)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = re.search(rb"\r\nContent-Length: *(\d+)", http)
                        rows.append((uri, at, number(fields.get("warc-record-id")), fields.get("warc-type"), number(fields.get("warc-refers-to")), fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(length[1]) if length else None, payload))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # Ranges are few and small rows; they are dealt evenly so that each task has one or a few.
    return ranges.repartition(min(100_000, max(1, ranges.count())), "path", "begin").mapInArrow(run, schema)


def plan_revisits(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest page_id of an equal payload of REVISIT_FROM bytes or more.

    Digests are grouped with partial sums, and only ids and digests meet in the join of a group; payloads move once, by their own id
    and digest. Rows that share a page_id are records of their own.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(payload, "UTF-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_FROM, F.concat(F.sha1("payload"), F.octet_length("payload").cast("string"))))
    digests = save(own.select("page_id", "digest").where("digest is not null and page_id is not null"), "digests")
    revisits = with_least(digests, "digest", "page_id", "refers_to", F.max).where("page_id < refers_to").distinct()
    return own.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    path = new_path(spark, "warc")
    write_archives(plan_revisits(table(spark, sf_dir, "pages")), path)
    back = read_archives(spark, path)
    whole = F.col("record_type") == "response"
    return back.select("page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"), F.when(whole, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, n, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY ALL)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest, CASE WHEN d.page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id < top THEN top END AS refers_to
FROM d LEFT JOIN m ON m.h = d.h AND m.n = d.n
"""
