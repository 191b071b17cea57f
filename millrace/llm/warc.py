"""WARC archives: a Python data source that reads them and a writer of text parts.

The reader plans a partition per file.  Filters on `record_type` and on headers are pushed
to it: a record's headers are parsed first, and the block of a record that no filter wants,
or of any record if no payload column is asked for, is passed over without being decoded.

The writer lays each record out as text and lets Spark write it, so archives reach any
store Spark writes to, and a lost task's files are replaced by Spark's commit.  Equal
payloads are written once: the page with the least id is a `response`, the others are
`revisit` records that refer to it.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from .frames import ready, renamed, text_of

HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
    "content_length": "Content-Length",
}
NUMBERS = ("payload_length", "content_length")
PAYLOAD = ("payload",)
SCHEMA = ", ".join(f"{name} {'bigint' if name in NUMBERS else 'string'}" for name in HEADERS) + ", payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 20
FILE_RECORDS = 20_000


@dataclass
class ArchiveFile(InputPartition):
    uri: str


def records(stream) -> Iterator[tuple[dict[str, str], "Block"]]:
    """Headers and block of each record; a block not read is skipped."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("A record does not begin with its version.")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise ValueError("A header has no name.")
            headers[name.strip().lower()] = value.strip()
        block = Block(stream, int(headers["content-length"]))
        yield headers, block
        block.skip()


class Block:
    """The bytes of a record after its headers, read on demand."""

    def __init__(self, stream, length: int):
        self.stream, self.left = stream, length

    def read(self) -> bytes:
        data = self.stream.read(self.left)
        if len(data) != self.left:
            raise EOFError("A record ends before its length.")
        self.left = 0
        return data

    def skip(self) -> None:
        while self.left:
            part = self.stream.read(min(self.left, CHUNK))
            if not part:
                raise EOFError("A record ends before its length.")
            self.left -= len(part)


def payload_of(headers: dict[str, str], block: Block) -> bytes:
    data = block.read()
    if headers.get("content-type", "").startswith("application/http"):
        return data.partition(b"\r\n\r\n")[2]
    return data


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over equality, membership and presence of header columns."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        system, root = fs.FileSystem.from_uri(self.path)
        parts = urlsplit(self.path)
        store = f"{parts.scheme or 'file'}://{parts.netloc if root.startswith('/') else ''}"
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [i.path for i in found if i.is_file and not i.base_name.startswith(("_", "."))]
        return [ArchiveFile(store + f) for f in sorted(files)]

    def value(self, headers: dict[str, str], name: str):
        text = headers.get(HEADERS[name].lower())
        return int(text) if text is not None and name in NUMBERS else text

    def wants(self, headers: dict[str, str]) -> bool:
        for name, values in self.wanted:
            value = self.value(headers, name)
            if value is None or (values is not None and value not in values):
                return False
        return True

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, path = fs.FileSystem.from_uri(partition.uri)
        columns: dict[str, list] = {name: [] for name in self.names}
        size = rows = 0
        with system.open_input_stream(path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=Buffered(raw)) if path.endswith(".gz") else Buffered(raw)
            for headers, block in records(stream):
                if not self.wants(headers):
                    continue
                for name in self.names:
                    if name in HEADERS:
                        columns[name].append(self.value(headers, name))
                    else:
                        data = payload_of(headers, block)
                        size += len(data)
                        columns[name].append(data)
                rows += 1
                if rows == 1000 or size > CHUNK * 4:
                    yield self.batch(columns)
                    columns, size, rows = {name: [] for name in self.names}, 0, 0
        if rows:
            yield self.batch(columns)

    def batch(self, columns: dict[str, list]) -> pa.RecordBatch:
        kinds = {name: pa.int64() if name in NUMBERS else pa.binary() if name in PAYLOAD else pa.string() for name in columns}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in columns.items()], list(columns))


class Buffered:
    """Lines and bytes of a stream that only knows how to read."""

    def __init__(self, raw):
        self.raw, self.data, self.at = raw, b"", 0

    def read(self, size: int = -1) -> bytes:
        if size < 0:
            rest, self.data, self.at = self.data[self.at :], b"", 0
            return rest + self.raw.read()
        parts, need = [], size
        while need:
            if self.at == len(self.data):
                self.data, self.at = self.raw.read(CHUNK), 0
                if not self.data:
                    break
            part = self.data[self.at : self.at + need]
            self.at += len(part)
            need -= len(part)
            parts.append(part)
        return b"".join(parts)

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.data.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.data[self.at : end + 1])
                self.at = end + 1
                break
            parts.append(self.data[self.at :])
            self.data, self.at = self.raw.read(CHUNK), 0
            if not self.data:
                break
        return b"".join(parts)


class WarcSource(DataSource):
    """`spark.read.format("warc").load(folder)`, after `register`.

    `schema` may be narrowed to the columns wanted: without `payload` no block is decoded.
    Folders reach the stores pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def base32(digits: Column) -> Column:
    """Forty hex digits in upper-case base32: ten digits are eight characters."""
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in upper-case base32."""
    return base32(F.sha1(data))


def record_text(
    page_id: Column, url: Column, html: Column, size: Column, digest: Column, first: Column, least_revisit: int
) -> Column:
    """One record up to, not including, its last line end."""
    end = "\r\n"
    revisit = (first != page_id) & (size >= least_revisit)
    revisit = F.coalesce(revisit, first.isNotNull() & (size >= least_revisit))
    name = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(html))

    def header(label: str, value, when=None):
        line = F.concat(F.lit(f"{label}: "), value, F.lit(end))
        return F.coalesce(line if when is None else F.when(when, line), F.lit(""))

    return F.concat(
        F.lit(f"WARC/1.1{end}"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", name(page_id)),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", safe),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        header("WARC-Payload-Length", size.cast("string")),
        header("WARC-Profile", F.lit(PROFILE), revisit),
        header("WARC-Refers-To", name(first), revisit),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(end),
        block,
        F.lit(end),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least_revisit: int = 0,
) -> None:
    """Write a record per page below `path`, compressed.

    Null html is an empty payload; a null url has no target header, and line ends in one
    are percent-encoded.  Among payloads of at least `least_revisit` bytes that are equal,
    all rows with the least id are responses and the others revisit it; rows without id
    refer to it too, and are responses if no row has an id.  An empty table writes none.
    """
    spark = ready(pages.sparkSession)
    source = renamed(pages, page_id=id_column, url=url_column, html=html_column)
    source = source.withColumn("html", text_of("html"))
    source = source.withColumn("hash", F.sha1(F.encode("html", "utf-8")))
    firsts = source.groupBy("hash").agg(F.min("page_id").alias("first"))
    joined = source.join(firsts, "hash").withColumn("digest", base32(F.col("hash")))
    joined = joined.withColumn("size", F.octet_length("html").cast("long"))
    columns = [F.col(c) for c in ("page_id", "url", "html", "size", "digest", "first")]
    text = record_text(*columns, least_revisit)
    joined.select(text.alias("value")).write.option("lineSep", "\r\n").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).option("compression", "gzip").text(path)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records below `path`; columns that are not asked for are not decoded."""
    register(ready(spark))
    reader = spark.read.format("warc")
    if columns is not None:
        kinds = StructType.fromDDL(SCHEMA)
        reader = reader.schema(StructType([kinds[c] for c in columns]))
    return reader.load(path)
