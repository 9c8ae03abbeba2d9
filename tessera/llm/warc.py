"""WARC archives: a writer by Spark's text sink and a Python data source that reads them.

Writing: a record is one value of the text sink and the sink's separator is the blank lines
that end a record, so any file system that Spark writes to will do. Payloads seen before
become revisit records. Reading: the archives' files are the partitions; filters on the record
type and on headers are pushed down, headers are parsed first, and the block of a record that
they exclude is passed over without being decoded.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tessera.llm._graph import checkpoint, shared_folder

#: Bytes of the list of repeated payloads (a digest and a number each) up to which it is broadcast; a longer one is joined by shuffle, salted.
BROADCAST_BYTES = 16 << 20
SALTS = 64
SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, content_length long, payload binary"
_HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_BATCH_BYTES = 8 << 20


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text or binary, by SQL functions: five bytes are eight digits."""
    digest = F.sha1(text)
    eights = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html, any others) to new gzip archives in ``path``.

    Of records with equal payloads of ``least_bytes`` or more that with the smallest page_id is a
    response and the others revisit it; smaller payloads are all responses. A null html is an empty payload,
    a null url gives no WARC-Target-URI, and control characters and blanks of a url are written as %20.
    Rows that repeat the smallest page_id with that payload are responses too; a null page_id is
    never the smallest unless there is no other. Pages may be of any length; columns beyond the three are not read.
    """
    page = F.col("page_id").cast("long")
    rows = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    seen = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = checkpoint(seen.select("digest", "first", F.lit(True).alias("again")))
    if seen.count() * 64 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(seen), "digest", "left")
    else:  # a payload that very many pages have is spread over as many keys
        salted = seen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["digest", "salt"], "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("bytes") >= least_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit(""),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class FilePart(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    raw = system.open_input_stream(path, compression=None)
    return gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)


def _lines_and_blocks(stream) -> Iterator[tuple[dict[str, str], int]]:
    """Headers and block length of each record; the caller takes the block before going on."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (raw := stream.readline()).strip(b"\r\n"):
            line = raw.strip(b"\r\n")
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        if not raw or "content-length" not in headers:
            raise ValueError("the archive ends within a header, or a record has no Content-Length")
        yield headers, int(headers["content-length"])


def _pass_over(stream, size: int) -> None:
    while size > 0:
        if not (found := len(stream.read(min(size, 1 << 20)))):
            raise ValueError(f"the archive ends {size} bytes before its last block does")
        size -= found


def _take(stream, size: int) -> bytes:
    block = stream.read(size)
    if len(block) < size:
        raise ValueError(f"the archive ends {size - len(block)} bytes before its last block does")
    return block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        prefix = self.path.partition(path)[0]
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = [f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [FilePart(prefix + n) for n in sorted(names)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in SCHEMA.split(", "))])
        rows, held = [], 0
        with _open(partition.value) as stream:
            for headers, size in _lines_and_blocks(stream):
                values = {c: headers.get(h) for c, h in _HEADERS.items()}
                if any(values[c] not in v for c, v in self.wanted.items()):
                    _pass_over(stream, size)
                    continue
                payload = None
                if self.payload and values["warc_type"] != "revisit":
                    payload = _take(stream, size)
                    if headers.get("content-type", "").startswith("application/http"):
                        payload = payload.partition(b"\r\n\r\n")[2]
                    held += len(payload)
                else:
                    _pass_over(stream, size)
                length = headers.get("x-payload-length")
                rows.append(values | {"payload_length": int(length) if length else None, "content_length": size, "payload": payload})
                if len(rows) >= 5000 or held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option payload=false leaves all payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives at ``path``, a file or folder: the columns of ``SCHEMA``.

    An archive that is cut short is an error, never a shorter result.

    Equality and IN on warc_type and the other header columns are pushed into the reader, for which
    this turns on ``spark.sql.python.filterPushdown.enabled``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the records back.

    A row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are
    measured on the payload read back, revisits by their headers.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, least_bytes)
    records = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("payload")), F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
