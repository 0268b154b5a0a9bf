"""Legacy archive converter: ARC files to WARC records, and WARC files read back.

ARC comes in two versions that differ in the fields of a record's header line:

    1  URL IP-address Archive-date Content-type Archive-length
    2  URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The first record of a file, `filedesc:`, says the version; records are cut by their declared length.
Each becomes a WARC record with a name-based record id, an ISO timestamp, a type and a digest.  Archives
are written by Spark's text sink, whose line separator is the end of a record, so any store Spark reaches
will do, and read as whole files, kept small by the number of files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinchgraph.llm.common import batches_of, rows_of, utf8
from pinchgraph.storage import materialize, scratch_path

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes a file should hold at most; a larger record has a file of its own.
FILE_BYTES = 32 << 20
#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 1_000

RECORD_SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, ip string, content_type string, http string, payload binary, payload_digest string, page_id long"


@dataclass(frozen=True)
class ArcRecord:
    """A header line's fields and the block of the declared length."""

    fields: dict[str, str]
    block: bytes


def _line(stream: BinaryIO) -> bytes:
    """The next line that is not blank, without its end; empty at the end of the file."""
    while line := stream.readline():
        if stripped := line.rstrip(b"\r\n"):
            return stripped
    return b""


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, without its `filedesc:` record.

    A header line with another number of fields than its version has is an error, as is a block shorter
    than declared: nothing is skipped silently.
    """
    names = None
    while line := _line(stream):
        values = line.decode("utf-8", "backslashreplace").split(" ")
        if names is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError(f"no filedesc record: {line[:80]!r}")
            head = stream.read(int(values[-1]))
            names = ARC_FIELDS[int(head.split(b" ", 1)[0])].split(" ")
            continue
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields where {len(names)} are declared: {line[:80]!r}")
        fields = dict(zip(names, values))
        size = int(fields["Archive-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{len(block)} of {size} bytes: {line[:80]!r}")
        yield ArcRecord(fields, block)


def warc_date(stamp: str) -> str:
    """An ARC date of 14 digits (or 12, 10, 8: cut from the right) as an ISO timestamp."""
    s = stamp + "00000101000000"[len(stamp) :] if len(stamp) < 14 else stamp
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, body) of a captured response; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, body = block.partition(b"\r\n\r\n")
    return head + mark, body


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("latin-1")
    return None


def to_warc(record: ArcRecord) -> tuple:
    """A row of `RECORD_SCHEMA`: what a WARC record of the same capture says.

    The id is a UUID of URL, date and digest, so converting twice gives the same ids.  A response to HTTP is
    `response`, an http(s) block without a head `resource`, anything else `resource` with its own type.
    """
    f = record.fields
    head, body = split_http(record.block)
    digest = hashlib.sha1(body).hexdigest()
    date = warc_date(f["Archive-date"])
    page = http_field(head, b"x-page-id")
    name = f"{f['URL']} {date} {digest} {page}"
    return (
        f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", "response" if head else "resource", f["URL"], date, f["IP-address"],
        "application/http; msgtype=response" if head else f["Content-type"], head.decode("latin-1"), body, digest,
        int(page) if page else None,
    )


def _opened(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in T.StructType.fromDDL(ddl)])


def read_arcs(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every ARC record under `path` as a row of `RECORD_SCHEMA`; without `payload` its bytes are left out."""
    schema = _arrow(RECORD_SCHEMA)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (content,) in rows_of(batches, "content"):
            for record in read_arc(_opened(content)):
                row = to_warc(record)
                yield row if payload else (*row[:7], None, *row[8:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), schema, 5_000, weigh=lambda r: 500 + len(r[7] or b""))

    return _files(spark, path).mapInArrow(run, RECORD_SCHEMA)


def _write_text(lines: DataFrame, path: str, end: str) -> None:
    lines.write.mode("overwrite").option("lineSep", end).option("compression", "gzip").text(path)


def write_arcs(pages: DataFrame, path: str, date: str = "20050102030405", ip: str = "0.0.0.0", files: int | None = None) -> None:
    """Write `pages(page_id, url, html)` as ARC files, those of even tasks as version 1, of odd ones as version 2.

    The block is an HTTP response with the html in UTF-8 (null: empty) as its body and the page's id in
    its head.  Blanks in a URL are escaped, as the header line is cut at blanks; a null URL becomes `urn:null`.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("urn:null")).alias("url"), utf8(F.col("html")).alias("html"))
    if files:
        rows = rows.repartition(files)
    schema = pa.schema([("value", pa.binary())])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        version = 1 + task % 2
        about = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
        extra = "" if version == 1 else " 200 - - 0 -"
        yield (f"filedesc://{task}.arc {ip} {date} text/plain{extra} {len(about)}\n".encode() + about,)
        for page_id, url, html in rows_of(batches, "page_id", "url", "html"):
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n"
            head += "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
            block = head.encode() + b"\r\n" + html
            safe = "".join(f"%{ord(c):02X}" if c in " \t\r\n" else c for c in url) or "urn:empty"
            yield (f"{safe} {ip} {date} text/html{extra} {len(block)}\n".encode() + block,)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(records(batches), schema, 5_000, weigh=lambda r: len(r[0]))

    _write_text(rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")), path, "\n")


def mark_revisits(records: DataFrame, digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """`records` with `refers_to`, the page whose payload a revisit repeats; its own payload is dropped.

    Of records with equal payloads of at least `least` bytes, that with the largest page_id stays a response.
    Records without an id refer to it too; where no record of the payload has an id, all stay.
    `digests(payload_digest, payload_bytes, page_id)` lists the records without their payloads.
    """
    large = digests.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    repeated = materialize(large.where("_n > 1 and _kept is not null").select("payload_digest", "_kept"), "repeated").df
    joined = records.join(repeated, "payload_digest", "left")
    again = F.col("_kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_kept"))
    return joined.select(
        *[c for c in records.columns if c not in ("payload", "warc_type")],
        F.when(again, "revisit").otherwise(F.col("warc_type")).alias("warc_type"),
        F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("_kept")).alias("refers_to"),
    )


def warc_text(records: DataFrame) -> DataFrame:
    """`value`: the WARC 1.1 record of each row, up to the separator that ends it."""
    schema = pa.schema([("value", pa.binary())])
    names = ("record_id", "warc_type", "target_uri", "warc_date", "ip", "content_type", "http", "payload", "payload_digest", "refers_to")

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for record_id, kind, uri, date, ip, content, http, payload, digest, refers_to in rows_of(batches, *names):
            block = http.encode("latin-1") + (payload or b"")
            head = {
                "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri, "WARC-Date": date, "WARC-IP-Address": ip,
                "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type": content, "Content-Length": len(block),
            }
            if kind == "revisit":
                head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Page": refers_to}
            yield (("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block,)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(lines(batches), schema, 5_000, weigh=lambda r: len(r[0]))

    return records.select(*names).mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def write_warcs(records: DataFrame, path: str) -> None:
    _write_text(warc_text(records), path, RECORD_END)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, cut by the declared length."""
    while line := _line(stream):
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins at {line[:80]!r}")
        head: dict[str, str] = {}
        while field := stream.readline().rstrip(b"\r\n"):
            key, _, value = field.partition(b":")
            head[key.decode("latin-1").lower()] = value.strip().decode("utf-8", "backslashreplace")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{len(block)} of {size} bytes in {head.get('warc-record-id')}")
        yield head, block


def read_warcs(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, warc_date (and payload) of each record.

    Digest and size of a record with its payload are taken from the bytes and must agree with the header; those
    of a revisit from its header and the HTTP head it repeats.
    """
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"
    ddl += ", payload binary" * payload
    schema = _arrow(ddl)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (content,) in rows_of(batches, "content"):
            for head, block in read_warc(_opened(content)):
                http, body = split_http(block)
                kind = head["warc-type"]
                told = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind != "revisit" and hashlib.sha1(body).hexdigest() != told:
                    raise ValueError(f"digest differs in {head['warc-record-id']}")
                size = int(http_field(http, b"content-length") or 0) if kind == "revisit" else len(body)
                page, refers = http_field(http, b"x-page-id"), head.get("warc-refers-to-page")
                row = (int(page) if page else None, size, told, kind, int(refers) if refers else None, head["warc-record-id"].strip("<>"), head["warc-target-uri"], head["warc-date"])
                yield (*row, body) if payload else row

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), schema, 5_000, weigh=lambda r: 500 + (len(r[-1]) if payload else 0))

    return _files(spark, path).mapInArrow(run, ddl)


def files_for(pages: DataFrame, html_col: str = "html") -> int:
    """How many files keep each near `FILE_BYTES`."""
    total = pages.agg(F.sum(F.octet_length(html_col).cast("long") + 500)).first()[0] or 0
    return max(1, -(-int(total) // FILE_BYTES))


def convert(spark: SparkSession, arc_path: str, warc_path: str, files: int | None = None, least: int = LEAST_REVISIT) -> None:
    """Convert the ARC files under `arc_path` to WARC files under `warc_path`, repeated payloads as revisits.

    Payloads of any bytes, empty ones included, pass unchanged; an empty folder gives an empty one.
    `files` is the number of files to write, by default as many as tasks.
    """
    # the payload's size is read from the head, so that no payload leaves the worker for the counts
    narrow = read_arcs(spark, arc_path, payload=False).select("payload_digest", "page_id", F.regexp_extract("http", r"(?i)\r\nContent-Length: *(\d+)", 1).cast("long").alias("payload_bytes"))
    marked = mark_revisits(read_arcs(spark, arc_path), materialize(narrow, "digests").df, least)
    write_warcs(marked.repartition(files) if files else marked, warc_path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` as ARC, convert to WARC and read that back: one row per page, as `read_warcs` gives without payloads.

    Repeated rows are records of their own; a null page_id stays null; other columns are ignored.
    """
    spark = pages.sparkSession
    files = files_for(pages)
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arcs(pages, arc, files=files if pages.rdd.getNumPartitions() < files else None)
    convert(spark, arc, warc)
    return read_warcs(spark, warc, payload=False)
