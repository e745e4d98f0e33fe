"""WARC archives as a Spark data source, in Python.

Reading plans partitions from the listing of the archive folder: whole files, gathered up to `split_bytes`.
Filters on record_type, record_id, target_uri and refers_to are pushed down to the reader. It parses a record's header
first; a record that fails the filters, or any record when the asked schema has no payload column, is passed over by a
seek (in gzip files by reading on), without decoding its block. Writing is one file per task, renamed by the
driver when the job commits, so files of failed or repeated tasks are never read.

Files are reached through pyarrow's file systems, so the folder may be on any store that they know.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from placeloom.llm.common import cut_lineage, scratch_path

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEADER = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
FILTERED = ("record_type", "record_id", "target_uri", "refers_to")
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_length long, headers map<string,string>, payload binary")
BATCH_BYTES = 4 << 20


def _field(name: str, value: str | None) -> str | None:
    """A header value as the columns show it: identifiers without their brackets."""
    return value[1:-1] if value and name in ("record_id", "refers_to") and value[:1] == "<" and value[-1:] == ">" else value


def _open(fs: pafs.FileSystem, path: str):
    raw = io.BufferedReader(fs.open_input_file(path), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _skip(f, n: int) -> None:
    if isinstance(f, gzip.GzipFile):
        while n > 0:
            got = len(f.read(min(n, 1 << 20)))
            if not got:
                raise EOFError("record ends early")
            n -= got
    else:
        f.seek(n, io.SEEK_CUR)


def read_records(f, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers with lower-case names, block length, payload) of the records whose headers pass `wanted`."""
    while True:
        line = f.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers, last = {}, None
        while (line := f.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("header ends early")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                headers[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        length = int(headers["content-length"])
        if not wanted(headers) or not with_payload:
            _skip(f, length)
            if wanted(headers):
                yield headers, length, None
            continue
        block = f.read(length)
        if len(block) < length:
            raise EOFError("record ends early")
        if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, length, block


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns in a WARC archive: {sorted(unknown)}")
        self.tests: list[tuple[str, frozenset | None]] = []  # None: any value but NULL

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FILTERED and f.value is not None:
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in FILTERED and None not in f.value:
                self.tests.append((f.attribute[0], frozenset(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in FILTERED:
                self.tests.append((f.attribute[0], None))
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.options["path"])
        split = int(self.options.get("split_bytes", 64 << 20))
        files = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz")) and not i.base_name.startswith((".", "_"))]
        parts, now, size = [], [], 0
        for i in sorted(files, key=lambda i: i.path):
            if now and size + i.size > split:
                parts.append(_Files(tuple(now)))
                now, size = [], 0
            now.append(i.path)
            size += i.size
        return parts + [_Files(tuple(now))]

    def read(self, partition: _Files):
        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        wanted = lambda h: all(HEADER[c] in h if v is None else _field(c, h.get(HEADER[c])) in v for c, v in self.tests)
        kinds = {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        types = [kinds.get(c, pa.string()) for c in self.names]
        rows, size = [], 0

        def batch():
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in self.names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=self.names)

        for path in partition.paths:
            with _open(fs, path) as f:
                for headers, length, payload in read_records(f, wanted, "payload" in self.names):
                    row = {"content_length": length, "payload": payload, "headers": list(headers.items())}
                    rows.append([row[c] if c in row else _field(c, headers.get(HEADER[c])) for c in self.names])
                    size += 500 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        yield batch()


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


def record(kind: str, record_id: str, uri: str | None, date: str | None, refers_to: str | None, digest: str | None, payload: bytes | None) -> bytes:
    """One record in bytes; a revisit has no payload."""
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    block = HTTP_HEAD + (b"" if kind == "revisit" else payload or b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{clean(record_id)}>", f"WARC-Date: {date or '1970-01-01T00:00:00Z'}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {clean(uri)}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{clean(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Rows with record_type, record_id, target_uri, date, refers_to, payload_digest and payload, one file per task."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.gz = options["path"], overwrite, options.get("compression", "none") == "gzip"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        path = f"{root}/.{uuid.uuid4().hex}.warc" + ".gz" * self.gz
        names = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload")
        count = 0
        with fs.open_output_stream(path, compression=None, buffer_size=1 << 20) as f:
            for b in batches:
                for row in zip(*(b.column(n).to_pylist() for n in names)):
                    raw = record(*row)
                    f.write(gzip.compress(raw, 1, mtime=0) if self.gz else raw)
                    count += 1
        if not count:
            fs.delete_file(path)
        return _Written(path if count else None)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and not i.base_name.startswith(".")] if self.overwrite else []
        for m in messages:
            if m and m.path:
                folder, _, name = m.path.rpartition("/")
                fs.move(m.path, f"{folder}/{name[1:]}")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages):
        fs, _ = pafs.FileSystem.from_uri(self.root)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of the archives in a folder; `columns` is the part of SCHEMA to read."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def page_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """WARC rows of pages: of equal payloads of `least` bytes or more only the one with the smallest id is kept in full.

    NULL html is an empty payload. Rows that repeat the smallest id are all responses; a NULL id is never the
    smallest unless no other is there.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    p = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    large = p.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = cut_lineage(large.where("n > 1").select("payload_digest", "first"))  # stored first, so that the join knows its size
    p = p.join(copies, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return p.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("id")).alias("record_id"), "target_uri",
        F.lit(None).cast("string").alias("date"), F.when(again, name(F.col("first"))).alias("refers_to"), "payload_digest",
        F.when(~again, F.col("payload")).alias("payload"))


def page_of(record: Column) -> Column:
    return F.nullif(F.substring(record, 10, 1 << 30), F.lit("")).cast("long")


def archive_digest(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of page archives, from the stored payloads.

    Responses are read with their payload, revisits by their headers alone; a revisit takes size and digest from the
    response that it refers to.
    """
    full = read(spark, path, "record_type string, record_id string, payload binary").where("record_type = 'response'")
    full = cut_lineage(full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")))
    again = read(spark, path, "record_type string, record_id string, refers_to string").where("record_type = 'revisit'")
    one = full.groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = again.join(one, "refers_to")
    size = ("payload_bytes", "payload_digest")
    return full.select(page_of(F.col("record_id")).alias("page_id"), *size, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.select(page_of(F.col("record_id")).alias("page_id"), *size, F.lit("revisit").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to")))


def archive_pages(pages: DataFrame, compression: str = "none", **more) -> str:
    """Write the pages' archives into the shared folder; the path."""
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    path = path if "://" in path or path.startswith("file:") else "file://" + path
    page_records(pages, **more).write.format("warc").option("compression", compression).mode("append").save(path)
    return path
