"""WARC archives: a writer of one gzip member for each record, and a sequential reader.

The reader inflates member after member in chunks, parses the header lines, frames the block by
Content-Length and checks that a member ends with its record and that block and payload have the
digests their headers state. Of equal payloads that reach `least` bytes one record is the response
and the others are revisits that refer to it and carry the HTTP header alone.

Which payloads are equal is settled on digests, with map-side aggregation, before any payload moves;
the pages that revisit are broadcast if they are few and joined by page otherwise. Files are written
to the shared folder under names that are new for each attempt, and only files of attempts that
ended are listed.

Defined results: a null or empty html is an empty payload; a null url has no target URI; of
repeated rows of the largest page_id one is the response; a null page_id is smaller than any other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import cut, open_fs, parts, read, scratch, small

LEAST_BYTES, FILE_BYTES, LEVEL, CHUNK = 0, 1 << 28, 4, 1 << 16
WRITTEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format or its digest."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, ident: str, uri: str | None, payload: bytes, refers_to: str | None = None, level: int = LEVEL) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {WRITTEN}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(head + block + b"\r\n\r\n") + c.flush()


def _members(stream) -> Iterator[bytes]:
    """The inflated members of a gzip stream, each for itself."""
    pending, inflate, out = b"", None, []
    while True:
        data = pending or stream.read(CHUNK)
        pending = b""
        if not data:
            if inflate is not None:
                raise WarcError("the file ends within a record")
            return
        inflate = inflate or zlib.decompressobj(31)
        try:
            out.append(inflate.decompress(data))
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from None
        if inflate.eof:
            yield b"".join(out)
            pending, inflate, out = inflate.unused_data, None, []


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, http header, payload) of each record, framed and verified."""
    for member in _members(stream):
        head, end, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not end or not lines[0].startswith("WARC/"):
            raise WarcError("a record does not start with its version")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(headers["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise WarcError("the content length does not frame the record")
        http, _, payload = block.partition(b"\r\n\r\n")
        checks = [(headers.get("warc-block-digest"), block)] + [(headers.get("warc-payload-digest"), payload)] * (headers["warc-type"] == "response")
        for stated, data in checks:
            if stated is not None and stated != "sha1:" + digest(data):
                raise WarcError(f"{headers.get('warc-record-id')}: digest mismatch")
        yield headers, http, payload


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes pages (page_id, url, html); rows (path, records), one for each file."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    marks = cut(page.select("page_id", "sha", F.octet_length("html").alias("size")).groupBy("page_id", "sha", "size").agg(F.count(F.lit(1)).alias("n")))
    heads = marks.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("head"), F.sum("n").alias("m")).where("m > 1").select("sha", "head", F.lit(True).alias("met"))
    refs = cut(marks.join(heads, "sha").where("not page_id <=> head or n > 1").select(F.coalesce("page_id", F.lit(0)).alias("p"), F.col("page_id").isNull().alias("none"), F.col("sha").alias("s"), "head", "n"))
    page = page.withColumn("p", F.coalesce("page_id", F.lit(0))).withColumn("none", F.col("page_id").isNull()).withColumn("s", F.col("sha"))
    page = page.join(small(refs), ["p", "none", "s"], "left")
    nth = F.lit(1)
    if not refs.where("n > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("p", "none", "s").orderBy(F.lit(0)))
    page = page.withColumn("nth", nth).select("page_id", "url", "html", F.when(F.col("n").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("head")) | (F.col("nth") > 1)), F.coalesce(F.col("head").cast("string"), F.lit("none"))).alias("ref"))

    def run(batches):
        out, path, size, count, done = None, "", 0, 0, []
        for b in batches:
            for ident, uri, html, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist()):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = open_fs(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                data = record("response" if ref is None else "revisit", "none" if ident is None else str(ident), uri, html.as_py(), ref, level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, count))
                    out, size, count = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done])], ["path", "records"])

    return cut(page.mapInArrow(run, "path string, records long"))


def read_warc(files: DataFrame) -> DataFrame:
    """files: path. A row for each record: page_id, uri, record_type, payload_bytes, payload_digest, refers_to, html (null for revisits)."""

    def number(x: str | None) -> int | None:
        x = x and x.removeprefix("<urn:page:").removesuffix(">")
        return None if x in (None, "none") else int(x)

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for h, http, payload in records(stream):
                        size = int(re.search(rb"(?i)^content-length: (\d+)", http, re.M)[1])
                        response = h["warc-type"] == "response"
                        if response and size != len(payload):
                            raise WarcError("the payload is not as long as its HTTP header states")
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], size, h["warc-payload-digest"].removeprefix("sha1:"), number(h.get("warc-refers-to")), payload.decode() if response else None))
                        held += len(payload)
                        if held > 1 << 23 or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("path").repartition(parts(files.count())).mapInArrow(run, "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(read(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
