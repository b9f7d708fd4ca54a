"""WARC archives as a PySpark Python data source, for reading and writing.

Reading: each partition is one archive file; the writer cuts files at a size.  Equality and IN
predicates on the record type and other header columns are pushed down: a record's header is parsed
first, and the payload of a record that fails them is skipped without being decoded.  A payload is not
decoded either when the ``payload`` option is ``false``.  Header lines may end in CR LF or in LF alone.

Writing: every task writes files of its own under a temporary name and the commit renames the files
of the tasks that succeeded and removes what failed tasks left, so a lost executor or a repeated task
leaves no second copy.  Files are reached through ``pyarrow.fs``, so any store with a URI that it knows
will do.

Page archives: which pages repeat a payload is settled on ids, lengths and SHA-256 digests alone.  The
payload of a page that nobody repeats is never shuffled, and of a group of copies only the response's is.

* Null payloads count as empty.  Null ids are written as an empty record name and read as null.
* Of equal payloads the smallest id is the response; null ids rank behind all others.  Rows that repeat
  the smallest id and its payload (ties) are all responses.  Rows that repeat an id with different
  payloads are records of their own.
* Payloads are written whole, whatever their length; a record's must fit a task's memory.
* Input columns beside id, url and html are ignored, also those named like an output.
* An empty table gives an empty archive folder, which reads as an empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from groundtable.llm.id_filter import mark_ids, passes
from groundtable.plans.shared import shared_path, short_batches, spill

RECORD_SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_HEADERS = {
    "record_type": b"warc-type",
    "record_id": b"warc-record-id",
    "target_uri": b"warc-target-uri",
    "payload_digest": b"warc-payload-digest",
    "refers_to": b"warc-refers-to",
}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def sha1_base32(digest_hex: str) -> str:
    """A SHA-1 in hex as bare upper-case base32."""
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def _record(kind: str, record_id: str | None, uri: str | None, digest: str | None, refers_to: str | None, size: int, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record: an HTTP response head, and the payload unless it is a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind != "revisit":
        block += payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:record:" + (record_id or "").encode() + b">",
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + (uri or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + (digest or "").encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if kind == "revisit":
        lines.insert(6, b"WARC-Profile: " + _PROFILE)
        lines.insert(7, b"WARC-Refers-To: <urn:record:" + (refers_to or "").encode() + b">")
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Gzip files of one member per record, cut at ``max_bytes`` compressed bytes; all records bear the job's start as their date."""

    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes
        self.job = uuid.uuid4().hex
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _filesystem(self.path)
        names: list[str] = []
        sink = None
        size = 0
        try:
            for batch in iterator:
                columns = [batch.column(name).to_pylist() for name in batch.schema.names]
                for values in zip(*columns):
                    row = dict(zip(batch.schema.names, values))
                    if sink is None:
                        names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                        system.create_dir(root, recursive=True)
                        sink, size = system.open_output_stream(f"{root}/_{names[-1]}", compression=None), 0
                    payload = row["payload"] or b""
                    member = gzip.compress(
                        _record(row["record_type"], row["record_id"], row["target_uri"], row["payload_digest"], row["refers_to"], row["payload_bytes"] or 0, payload, self.date),
                        compresslevel=1,
                        mtime=0,
                    )
                    sink.write(member)
                    size += len(member)
                    if size >= self.max_bytes:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        return _Written(tuple(names))

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/_{name}", f"{root}/{name}")
        self._remove_rest()

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove_rest()

    def _remove_rest(self) -> None:
        """Delete what tasks of this job wrote and did not hand over."""
        system, root = _filesystem(self.path)
        for info in system.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True)):
            if info.base_name.startswith(f"_part-{self.job}-"):
                system.delete_file(info.path)


@dataclass
class _File(InputPartition):
    name: str
    size: int


class WarcReader(DataSourceReader):
    """One partition per archive file, largest first; files whose name starts with _ are not yet committed."""

    def __init__(self, path: str, schema: T.StructType, payload: bool):
        self.path, self.columns, self.payload = path, schema.names, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for item in filters:
            if isinstance(item, (EqualTo, In)) and len(item.attribute) == 1 and item.attribute[0] in _HEADERS:
                values = {item.value} if isinstance(item, EqualTo) else set(item.value)
                known = self.wanted.get(item.attribute[0])
                self.wanted[item.attribute[0]] = values if known is None else known & values
            else:
                yield item

    def partitions(self) -> list[_File]:
        system, root = _filesystem(self.path)
        infos = system.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        files = [i for i in infos if i.is_file and not i.base_name.startswith(("_", ".")) and ".warc" in i.base_name]
        return [_File(i.path, i.size) for i in sorted(files, key=lambda i: (-i.size, i.path))] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, _ = _filesystem(self.path)
        rows: list[dict] = []
        held = 0
        with system.open_input_stream(partition.name, compression=None) as raw:
            for row in self._records(_Bytes(raw, partition.name.endswith(".gz"))):
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held >= 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns
        )

    def _records(self, source: _Bytes) -> Iterator[dict]:
        while (line := source.line()) is not None:
            if not line.startswith(b"WARC/"):
                continue
            head = {}
            while line := source.line():
                key, _, value = line.partition(b":")
                head[key.strip().lower()] = value.strip()
            length = int(head.get(b"content-length", b"0"))
            row = {column: _value(head.get(key), column) for column, key in _HEADERS.items()}
            if any(row[column] not in values for column, values in self.wanted.items()):
                source.skip(length)
                continue
            row |= {"payload": None, "payload_bytes": None}
            is_http = head.get(b"content-type", b"").startswith(b"application/http")
            left = length
            if is_http:
                while left > 0 and (line := source.line()) is not None:
                    left -= source.consumed
                    if not line:
                        break
                    if line[:15].lower() == b"content-length:":
                        row["payload_bytes"] = int(line[15:])
            if row["record_type"] != "revisit" and self.payload:
                row["payload"] = source.take(left)
            else:
                source.skip(left)
            yield row


def _value(raw: bytes | None, column: str) -> str | None:
    if raw is None:
        return None
    text = raw.decode("utf-8", "replace")
    if column in ("record_id", "refers_to"):
        text = text.strip("<>").removeprefix("urn:record:")
    elif column == "payload_digest":
        text = text.removeprefix("sha1:")
    return text or None


class _Bytes:
    """A byte stream with lines and skips, unpacking gzip members one after another."""

    def __init__(self, raw, packed: bool):
        self.raw, self.packed = raw, packed
        self.buffer, self.at = b"", 0
        self.consumed = 0  # bytes of the last line, its end included
        self.unpack = zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        chunk = b""
        while not chunk:
            if self.packed and self.unpack.unused_data:
                rest = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
                chunk = self.unpack.decompress(rest)
                continue
            data = self.raw.read(1 << 20)
            if not data:
                return False
            if self.packed and self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            chunk = self.unpack.decompress(data) if self.packed else data
        self.buffer, self.at = self.buffer[self.at :] + chunk, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the stream."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                return None
        found = self.buffer[self.at : end]
        self.at, self.consumed = end + 1, end + 1 - self.at
        return found.removesuffix(b"\r")

    def take(self, size: int) -> bytes:
        parts = []
        while size > 0:
            if self.at >= len(self.buffer) and not self._more():
                break
            part = self.buffer[self.at : self.at + size]
            self.at += len(part)
            size -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, size: int) -> None:
        while size > 0 and (self.at < len(self.buffer) or self._more()):
            step = min(size, len(self.buffer) - self.at)
            self.at += step
            size -= step


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("payload", "true") != "false")

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("max_bytes", 256 << 20)))


def register_warc(spark: SparkSession) -> None:
    """Make the ``warc`` format known to a session and let it push predicates down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


@F.pandas_udf(T.StringType())
def _base32(digests):
    return digests.map(sha1_base32, na_action="ignore")


def _may_be_in(spark: SparkSession, ids: DataFrame):
    """A column function that lets the values of ``ids`` pass, and few others."""
    bitmap = spark.sparkContext.broadcast(mark_ids(ids))

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        return pa.array(passes(values, bitmap.value))

    return test


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """WARC records of pages: of equal payloads the smallest id is the response, others revisit it."""
    spark = pages.sparkSession
    short_batches(spark)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("payload")).withColumn(
        "key", F.xxhash64("payload")
    )
    named = lambda df: df.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256), "digest_hex": F.sha1("payload")}
    )
    keys = spill(named(rows).drop("payload"), "payload-keys")
    groups = spill(
        keys.groupBy("sha256", "payload_bytes").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.count("*").alias("copies"))
        .where("copies > 1").drop("copies"),
        "payload-groups",
    )
    repeats = _may_be_in(spark, groups.select(F.col("key").alias("id")))
    joined = keys.where(repeats("key")).join(groups.drop("key"), ["sha256", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("id") != F.col("first"), F.col("id").isNull() & F.col("first").isNotNull())
    twins = spill(joined.withColumn("revisit", revisit), "payload-twins")
    heads = twins.where("NOT revisit").select(F.col("id").alias("head"), F.col("sha256").alias("head_sha256"))
    is_head = _may_be_in(spark, heads.select(F.col("head").alias("id")))
    alone = named(rows.where(~repeats("key")))
    leading = named(rows.where(repeats("key") & is_head("id"))).join(
        heads, F.col("id").eqNullSafe(F.col("head")) & (F.col("sha256") == F.col("head_sha256")), "left_semi"
    )
    columns = ["id", "target_uri", "digest_hex", "payload_bytes"]
    responses = alone.unionByName(leading).select(
        F.lit("response").alias("record_type"), *columns, F.lit(None).cast("string").alias("refers_to"), "payload"
    )
    revisits = twins.where("revisit").select(
        F.lit("revisit").alias("record_type"), *columns, F.col("first").cast("string").alias("refers_to"), F.lit(None).cast("binary").alias("payload")
    )
    records = responses.unionByName(revisits).withColumn("record_id", F.col("id").cast("string"))
    return records.withColumn("payload_digest", _base32("digest_hex")).select(*[f.split()[0] for f in WRITE_SCHEMA.split(", ")])


def write_pages(pages: DataFrame, path: str, **columns: str) -> None:
    """Write a page table as WARC files below ``path``."""
    register_warc(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").save(path)


def archive_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages as WARC into the shared folder and read the records back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path, **columns)
    return spark.read.format("warc").load(path)


@F.pandas_udf(T.StringType())
def payload_sha1(payloads):
    """Bare base32 SHA-1 of a payload column."""
    return payloads.map(lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode(), na_action="ignore")
