"""WARC archives as a Spark data source (operator 9).

``spark.read.format("warc").load(folder)`` plans one partition for each file.
Predicates on the record type and other header columns are pushed down: a
reader parses a record's header first and steps over the block of a record
that they reject, or whose payload isn't wanted (option ``payload`` false),
without reading or decoding it.  ``.gz`` archives are read as streams.

The writer rolls files at a bounded size.  Tasks write under hidden names; the
driver renames what the successful attempts wrote, so a lost executor leaves
no half file or second copy.  Files are reached through Arrow's file systems,
by the folder's URI.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..session import scratch_path

SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, content_length long, payload binary"
)
#: Payloads of at least so many bytes are stored once; bytes after which a file is closed; records of a batch read.
LEAST_SHARED, FILE_BYTES, BATCH = 1000, 128 * 2**20, 256
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "content_length")
_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNotNull: lambda v, f: v is not None,
    IsNull: lambda v, f: v is None,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
}


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), path


def _line(value: str) -> str:
    """A header value: line ends would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """One archive record; the payload is stored compressed as HTTP content."""
    revisit = row["record_type"] == "revisit"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        block = f"{http}\r\n".encode()
    else:
        body = zlib.compress(row["payload"] or b"", 1)
        block = f"{http}Content-Encoding: deflate\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['page_id']))}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['url'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        to = row["refers_to"]
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(to))}>", f"X-Refers-To-Page: {to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, its content encoding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = head.lower().split(b"\r\n")
    if b"content-encoding: deflate" in fields:
        return zlib.decompress(body)
    return gzip.decompress(body) if b"content-encoding: gzip" in fields else body


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def headers(lines: dict[str, str]) -> dict:
    """The header columns of a record."""
    digest = lines.get("warc-payload-digest")
    return {
        "page_id": _number(lines.get("x-page-id")),
        "url": lines.get("warc-target-uri"),
        "record_type": lines.get("warc-type"),
        "refers_to": _number(lines.get("x-refers-to-page")),
        "payload_bytes": _number(lines.get("x-payload-length")),
        "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
        "content_length": int(lines.get("content-length", "0")),
    }


def records(stream, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of an open archive that ``wanted(header columns)`` accepts; other blocks are stepped over."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        lines, last = {}, None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:
                lines[last] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                last = name.strip().lower()
                lines[last] = value.strip()
        row = headers(lines)
        size = row["content_length"]
        if not wanted(row):
            stream.seek(size, io.SEEK_CUR)
        elif with_payload and row["record_type"] == "response":
            row["payload"] = payload_of(stream.read(size))
            yield row
        else:
            stream.seek(size, io.SEEK_CUR)
            yield row | {"payload": None}


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, path = _folder(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
        names = sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", ".")) and x.base_name.endswith((".warc", ".warc.gz")))
        return [WarcFile(x) for x in names] or [WarcFile("")]

    def read(self, partition):
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("content_length", pa.int64()), ("payload", pa.binary()),
        ])
        if not partition.path:
            yield pa.RecordBatch.from_pylist([], schema)
            return
        system, _ = _folder(self.path)
        wanted = lambda row: all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters)
        with system.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 2**20)
            rows = []
            for row in records(stream, wanted, self.with_payload):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator):
        system, path = _folder(self.path)
        system.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = system.open_output_stream(posixpath.join(path, "_" + files[-1])), 0
                data = record(row)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, path = _folder(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(posixpath.join(path, "_" + name), posixpath.join(path, name))

    def abort(self, messages):
        system, path = _folder(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.delete_file(posixpath.join(path, "_" + name))


class WarcDataSource(DataSource):
    """Format ``warc``: a folder of archives."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame) -> DataFrame:
    """Archive rows of pages: of equal payloads of at least ``LEAST_SHARED`` bytes, the largest page_id is the response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    first = (
        rows.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    joined = rows.join(first.select("payload_digest", "first"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
        "payload_bytes", "payload_digest", F.lit(0).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per row, read the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Size and digest of a response are those of the payload that was read; a
    revisit's come from its header, its block isn't read.  A null html is an
    empty payload.  Rows that repeat the largest id of a payload are responses
    each; rows without an id revisit a row that has one.  Other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc")
    responses = back.load(path).where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to"
    )
    revisits = back.option("payload", "false").load(path).where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)
