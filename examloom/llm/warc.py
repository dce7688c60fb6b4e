"""Operator 9: WARC archives, written and read back, and transactions assembled.

Writing: each page becomes three records: the response (or a revisit of an earlier response with the same payload),
its request, and a metadata record with the page's id; request and metadata name the response in
WARC-Concurrent-To.  Records are built by DataFrame functions and written by Spark's text writer, which puts
bytes down as they are, so archives land in any store that Spark can write.  Reading: files are parsed in
Arrow batches, one row per record.  Assembly: request and metadata records are joined to their response through the
concurrent-to identifiers: one nested row per capture; a revisit's page is found through WARC-Refers-To.

Edge cases: a null html is an empty payload; empty payloads are equal payloads like any; a null url leaves out the
target; line ends in a url are percent-encoded; a null page_id stays null and sorts last; repeated page ids with
equal payloads: one record is the response, the others revisit it; an empty table writes no archive
and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_dir, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes that one archive file gets, about; a larger page has a file's share to itself.
FILE_BYTES = 24 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, http_status int, payload_bytes long, payload_digest string, fields map<string,string>"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: thirty-two digits of five bits from the forty hex digits."""
    digest = F.sha1(data)
    digits = []
    for i in range(32):
        at, off = divmod(5 * i, 4)
        byte = F.conv(F.substring(F.concat(digest, F.lit("0")), at + 1, 2), 16, 10).cast("int")
        digits.append(F.substring(F.lit(BASE32), F.shiftright(byte, 3 - off).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)))
    return F.concat(*digits)


def _record(headers: list[Column], block: Column) -> Column:
    """A record without its last line end, which the text writer adds."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *headers, length), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def _named(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def records(pages: DataFrame) -> DataFrame:
    """The records of each page as text, three rows a page, dealt over files by payload bytes."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))), "warc-pages")
    ids = rows.select("row", "page_id", "digest")
    least = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = ids.groupBy("digest").agg(F.min(least).alias("first")).select("digest", F.col("first.row").alias("first_row"))
    later = ids.join(first, "digest").filter("row <> first_row").select("row", "first_row")
    total = rows.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
    files = max(1, total // FILE_BYTES + 1)
    rows = rows.repartition(files, "row").join(later.repartition(files, "row").hint("shuffle_hash"), "row", "left")

    def urn(row: Column, kind: str) -> Column:
        h = F.md5(F.concat(F.lit(kind), row.cast("string")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    own = urn(F.col("row"), "response")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target, date = _named("WARC-Target-URI", url), F.lit(f"WARC-Date: {DATE}")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    again = F.col("first_row").isNotNull()
    shared = [date, _named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), target, F.lit("Content-Type: application/http;msgtype=response")]
    response = _record([F.lit("WARC-Type: response"), _named("WARC-Record-ID", own), *shared], F.concat(http, "html"))
    revisit = _record(
        [F.lit("WARC-Type: revisit"), _named("WARC-Record-ID", own), _named("WARC-Refers-To", urn(F.col("first_row"), "response")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *shared], http
    )
    concurrent = _named("WARC-Concurrent-To", own)
    get = F.concat(F.lit("GET "), F.coalesce(url, F.lit("*")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record([F.lit("WARC-Type: request"), _named("WARC-Record-ID", urn(F.col("row"), "request")), concurrent, date, target, F.lit("Content-Type: application/http;msgtype=request")], get)
    meta = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record([F.lit("WARC-Type: metadata"), _named("WARC-Record-ID", urn(F.col("row"), "metadata")), concurrent, date, target, F.lit("Content-Type: application/warc-fields")], meta)
    return rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str) -> str:
    """Archives of ``pages`` under ``path``; returns ``path``."""
    records(pages).write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


class _Inflated(io.RawIOBase):
    """The bytes of a gzip file of one or more members, inflated as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.ready = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.ready:
            if self.z.eof:
                rest = self.z.unused_data
                self.at -= len(rest)
                self.z = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return 0
            step = self.data[self.at : self.at + (1 << 18)]
            self.at += len(step)
            self.ready = self.z.decompress(step)
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, gzipped or plain; a cut-off record is left out."""
    stream = io.BufferedReader(_Inflated(data), 1 << 18) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        block = stream.read(length)
        if len(block) < length:
            return
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple[tuple, bytes | None]:
    kind, payload, size, status, fields = headers.get("warc-type"), None, None, None, None
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        head, _, body = block.partition(b"\r\n\r\n")
        lines = head.decode("latin-1").split("\r\n")
        status = int(lines[0].split(" ")[1])
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if kind == "response":
            payload, size, digest = body, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            size = int(http["content-length"]) if "content-length" in http else None
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k}
    got = (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), status, size, digest, fields)
    return got, payload


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record under ``path``, with the payload of responses if asked for."""
    bound_batches(spark)
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * payload
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for headers, block in parse(data.as_py()):
                    got, body = _row(headers, block)
                    rows.append((*got, body) if payload else got)
                    held += len(body or b"") * payload + 400
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * payload)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the requests and metadata that name it."""
    parts = [c for c in recs.columns if c != "payload"]
    heads = recs.filter("type in ('response', 'revisit')").select(F.col("record_id"), F.struct(*recs.columns).alias("response"))
    out = heads
    for kind, name in (("request", "requests"), ("metadata", "metadata")):
        side = recs.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.sort_array(F.collect_list(F.struct(*(c for c in parts if c != "fields")))).alias(name), F.max(F.element_at("fields", "page-id")).alias(f"_{name}"))
        out = out.join(side if kind == "metadata" else side.drop(f"_{name}"), "record_id", "left")
    return out.withColumnRenamed("_metadata", "page_id")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """One row per page, from archives written and read back."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    path = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    captures = assemble(written(read_archives(spark, path, payload=False), "warc-records"))
    flat = captures.select("record_id", F.expr("nullif(page_id, '')").cast(kind).alias("page_id"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest")
    flat = written(flat, "captures")
    firsts = flat.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"))
    out = flat.join(firsts, "refers_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
