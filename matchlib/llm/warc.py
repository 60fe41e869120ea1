"""WARC archives: one gzip member for each record, and a sequential reader.

Writing: pages are grouped by the SHA-1 of their payload with a partial
aggregation, so that a payload shared by any number of pages costs one row for
each task; only digests that occur again are joined back. Each task writes its
pages to archives of bounded size.

Reading: an archive is read in order, in small pieces, each member inflated
incrementally; a record is framed by its Content-Length as it is inflated, and
both its digests are verified. A task holds one payload at most, and only if
payloads are asked for.

Defined results: a null html is an empty payload; a null or multi-line url is
written in one line, a null one as ``urn:unknown``; of equal payloads the rows
with the smallest page_id are responses (all of them, should that page_id be
repeated), the others revisit them; rows with a null page_id revisit a page of
equal payload if there is one that has an id; an empty table gives no archive
and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir

MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(*what) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, what))).urn}>"


def _one_line(url: str | None) -> str:
    return "".join((url or "").splitlines()).strip() or "urn:unknown"


def _framed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def info(name: str, date: str) -> bytes:
    """The warcinfo record that an archive begins with, uncompressed."""
    block = b"format: WARC File Format 1.1\r\n"
    return _framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("warcinfo", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None, date: str) -> bytes:
    """One WARC record, uncompressed: a response, or a revisit of the page refers_to (page_id, url)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        first, first_url = refers_to
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(first, digest, first_url)), ("WARC-Refers-To-Target-URI", _one_line(first_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(first))]
    return _framed(headers, http if refers_to is not None else http + payload)


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 1 << 28) -> DataFrame:
    """Writes pages(page_id, url, html); returns the written manifest, a row for each archive."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    first = pages.where(F.length("payload") >= min_revisit_bytes).groupBy("sha1").agg(least, F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    other = (F.col("page_id") != F.col("first.page_id")) | F.col("page_id").isNull()
    joined = pages.join(first, "sha1", "left").select("page_id", "url", "payload", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.url")).alias("first_url"))

    def write(batches):
        context = TaskContext.get()
        part, attempt, seq = context.partitionId(), context.taskAttemptId(), 0
        fs, path = pafs.FileSystem.from_uri(f"{folder}/archives")
        fs.create_dir(path, recursive=True)
        out = None

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/archives/{name}"], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, data, refers_to, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    # no other attempt of the task has this name; Spark commits the one that counts to the manifest
                    name, n = f"{part:06d}-{seq:04d}-{attempt}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    size = out.write(gzip.compress(info(name, date), mtime=0))
                member = gzip.compress(record(page_id, url, data, digest32(data), None if refers_to is None else (refers_to, first_url), date), mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out, seq = None, seq + 1
        if out is not None:
            yield closed()

    joined.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Records:
    """The records of an open archive, in order: (headers by lower-case name, HTTP header, payload, its length)."""

    def __init__(self, stream, with_payload: bool = True, at_once: int = 1 << 16):
        self.stream, self.with_payload, self.at_once = stream, with_payload, at_once
        self.raw = b""

    def __iter__(self):
        while True:
            self.raw = self.raw or self.stream.read(self.at_once)
            if not self.raw:
                return
            self.inflate = zlib.decompressobj(wbits=31)
            yield self._record()

    def _more(self) -> bytes:
        """The next inflated bytes of this member, at_once at most; none at its end."""
        while not self.inflate.eof:
            out = self.inflate.decompress(self.raw, self.at_once)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
            if not self.inflate.eof and not self.raw:
                self.raw = self.stream.read(self.at_once)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
        return b""

    def _record(self) -> tuple[dict[str, str], bytes, bytes | None, int]:
        head = b""
        while b"\r\n\r\n" not in head:
            more = self._more()
            if not more:
                raise ValueError("not a WARC record")
            head += more
        head, _, rest = head.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        name, n = headers.get("warc-record-id"), int(headers["content-length"])
        block, payload, length = hashlib.sha1(), hashlib.sha1(), 0
        http: bytes | None = b"" if headers.get("warc-type") in ("response", "revisit") else None
        in_http, kept, left = http is not None, [], n
        while left:
            rest = rest or self._more()
            piece = rest[:left]
            if not piece:
                raise ValueError(f"record {name}: its length is not {n}")
            rest, left = rest[len(piece) :], left - len(piece)
            block.update(piece)
            if in_http:
                http += piece
                if b"\r\n\r\n" in http:
                    http, _, piece = http.partition(b"\r\n\r\n")
                    in_http = False
            if not in_http:
                payload.update(piece)
                length += len(piece)
                if self.with_payload:
                    kept.append(piece)
        while more := self._more():
            rest += more
        if rest != b"\r\n\r\n":
            raise ValueError(f"record {name}: its length is not {n}")
        base32 = lambda sha: f"sha1:{base64.b32encode(sha.digest()).decode()}"
        if headers.get("warc-block-digest", base32(block)) != base32(block):
            raise ValueError(f"record {name}: wrong block digest")
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", base32(payload)) != base32(payload):
            raise ValueError(f"record {name}: wrong payload digest")
        return headers, http or b"", b"".join(kept) if self.with_payload else None, length


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of the archives; payload only with with_payload (a revisit has none). Raises on a wrong length or digest."""

    def read(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, http, payload, n in Records(stream, with_payload):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        response = h["warc-type"] == "response"
                        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if response and n != length:
                            raise ValueError(f"record {h['warc-record-id']}: its payload has {n} bytes, not {length}")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_number(h.get("x-page-id")), h["warc-target-uri"], h["warc-type"], _number(h.get("x-refers-to-page-id")), length, digest, payload if response else None))
                        size += len(payload or b"")
                        if len(rows) >= 1000 or size >= 1 << 24:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return manifest.select("archive").repartition(max(1, manifest.count()), "archive").mapInArrow(read, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT hex, min(page_id) AS first FROM p GROUP BY hex
), v AS (
  SELECT p.page_id, strlen(p.html) AS payload_bytes, f.first,
    list_transform(range(0, 8), lambda g:
      list_reduce(list_transform(range(1, 6), lambda k: CAST(instr('0123456789abcdef', substr(p.hex, CAST(g * 5 + k AS INT), 1)) - 1 AS BIGINT)), lambda a, x: a * 16 + x)) AS g20
  FROM p JOIN f USING (hex)
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(g20, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""
