"""Files of coded token ids, and documents as token ids through them.

A file is a sequence of segments of at most ``segment_ids`` ids.  A segment holds the ids and lengths
of the documents (or parts of documents) in it, the frequencies of its token ids, and blocks of
``block_ids`` ids, each coded from the same starting state (:mod:`groundtable.llm.token_coder`) and with the
CRC-32 of its ids, so a block can be read without the others.  All integers are little-endian::

    "TIDS" | segment ids, block ids, blocks, documents (4 x u32) | sizes of the two tables (2 x u32) | CRC-32 of both (u32)
    document table: zlib of flags u8, ids i64, lengths u32     flags: 1 id is null, 2 continues the last document
    frequency table: zlib of token ids u32 and frequencies u32
    block table: size u32 and CRC-32 u32 of each block | the blocks

``write_tokens`` deals documents out by ranges of their id and sorts each range; tasks write files under
temporary names, and the commit renames those of the tasks that succeeded, numbers them in order and
stores in ``_manifest.json`` how many ids stand before each file.  A repeated or lost task leaves nothing.
Readers plan one partition a file and check every CRC; damage raises an error.

* Null text counts as empty: the end id alone.  Null ids come last.  Rows that repeat an id are documents of
  their own, in the order of their texts' hashes; equal rows are told apart by their place, so they spread
  over tasks.  An empty table gives a folder without segments, which reads as an empty table.
* Texts are encoded whole; one of more ids than a segment continues in the next.
* Vocabularies have at most 65,536 ids.  Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from groundtable.llm.chunk_tokens import ChunkTokens
from groundtable.llm.token_coder import decode, encode, prior_table
from groundtable.plans.shared import shared_path, short_batches, shuffle_width

TOKENS = "id long, start long, n_tokens long, ids binary"
_MAGIC = b"TIDS"
_HEAD = struct.Struct("<4s6I")
_WIDTH = 1024  # entries of a block's context tables
_NULL, _MORE = 1, 2


@dataclass(frozen=True)
class TokenParams:
    """``vocabulary`` names a published vocabulary file; ``end_id`` follows every document."""

    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    block_ids: int = 2048
    segment_ids: int = 1 << 23
    file_ids: int = 1 << 26


class DamagedFile(ValueError):
    """A token file whose bytes are not those that were written."""


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _columns(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids by step and block, lengths); only the last block is shorter."""
    blocks = -(-len(ids) // block)
    padded = np.zeros(blocks * block, dtype=np.int64)
    padded[: len(ids)] = ids
    lengths = np.full(blocks, block, dtype=np.int64)
    lengths[-1] = len(ids) - (blocks - 1) * block
    return np.ascontiguousarray(padded.reshape(blocks, block)[:, : int(lengths[0])].T), lengths


def pack_segment(ids: np.ndarray, docs: list[tuple[int | None, int, bool]], block: int) -> bytes:
    """One segment; ``docs`` are (id, number of ids, whether it continues the last document)."""
    flags = bytes(_NULL * (d is None) | _MORE * more for d, _, more in docs)
    names, lengths = np.array([d or 0 for d, _, _ in docs], dtype="<i8"), np.array([n for _, n, _ in docs], dtype="<u4")
    table = zlib.compress(flags + names.tobytes() + lengths.tobytes(), 1)
    prior = prior_table(np.bincount(ids))
    some = np.flatnonzero(prior)
    frequencies = zlib.compress(some.astype("<u4").tobytes() + prior[some].astype("<u4").tobytes(), 1)
    columns, sizes = _columns(ids, block)
    coded = encode(columns, sizes, prior, _WIDTH)
    raw = memoryview(ids.astype("<u4").tobytes())
    blocks = b"".join(struct.pack("<2I", len(c), zlib.crc32(raw[4 * i * block : 4 * (i + 1) * block])) for i, c in enumerate(coded))
    check = zlib.crc32(blocks, zlib.crc32(frequencies, zlib.crc32(table)))
    head = _HEAD.pack(_MAGIC, len(ids), block, len(coded), len(docs), len(table), len(frequencies))
    return b"".join([head, struct.pack("<I", zlib.crc32(head, check)), table, frequencies, blocks, *coded])


class Segment:
    """A segment read from a stream; ``ids`` decodes all its blocks, or some."""

    def __init__(self, source):
        self.head = source.read(_HEAD.size)
        self.at_end = not self.head
        if self.at_end:
            return
        if len(self.head) < _HEAD.size or not self.head.startswith(_MAGIC):
            raise DamagedFile("not a segment of token ids")
        _, self.n_ids, self.block, n_blocks, n_docs, table_size, frequency_size = _HEAD.unpack(self.head)
        check, table, frequencies, blocks = source.read(4), source.read(table_size), source.read(frequency_size), source.read(8 * n_blocks)
        found = zlib.crc32(self.head, zlib.crc32(blocks, zlib.crc32(frequencies, zlib.crc32(table))))
        if check != struct.pack("<I", found):
            raise DamagedFile("the tables of a segment do not match their checksum")
        self.sizes, self.checks = np.frombuffer(blocks, dtype="<u4").reshape(-1, 2).T
        self.coded = [source.read(int(size)) for size in self.sizes]
        if any(len(c) != size for c, size in zip(self.coded, self.sizes)):
            raise DamagedFile("a segment ends early")
        raw = zlib.decompress(table)
        self.flags = np.frombuffer(raw, dtype=np.uint8, count=n_docs)
        self.names = np.frombuffer(raw, dtype="<i8", count=n_docs, offset=n_docs)
        self.lengths = np.frombuffer(raw, dtype="<u4", offset=9 * n_docs).astype(np.int64)
        some, values = np.frombuffer(zlib.decompress(frequencies), dtype="<u4").reshape(2, -1)
        self.prior = np.zeros(int(some.max()) + 1, dtype=np.int64)
        self.prior[some] = values

    def ids(self, wanted: list[int] | None = None) -> np.ndarray:
        """The ids of the ``wanted`` blocks (all by default), one block after another."""
        picked = np.arange(len(self.coded)) if wanted is None else np.array(sorted(wanted))
        sizes = np.minimum(self.block, self.n_ids - picked * self.block)
        found = decode([self.coded[i] for i in picked], sizes, self.prior, _WIDTH)
        out = []
        for i, size, column in zip(picked.tolist(), sizes.tolist(), np.ascontiguousarray(found.T)):
            part = column[:size].astype("<u4")
            if zlib.crc32(part.tobytes()) != self.checks[i]:
                raise DamagedFile(f"block {i} does not match its checksum")
            out.append(part)
        return np.concatenate(out)


_encoders: dict[str, ChunkTokens] = {}


def _encoder(vocabulary: str) -> ChunkTokens:
    """One encoder per Python worker, so remembered chunks serve all its tasks."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = ChunkTokens(public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: tuple[tuple[str, int], ...]


class TokenWriter(DataSourceArrowWriter):
    """Codes (id, text) rows as they come; files are cut after ``file_ids`` ids."""

    def __init__(self, path: str, params: TokenParams):
        self.path, self.params, self.job = path, params, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _filesystem(self.path)
        encoder = _encoder(self.params.vocabulary)
        files: list[tuple[str, int]] = []
        sink, in_file = None, 0
        held: list[np.ndarray] = []
        docs: list[tuple[int | None, int, bool]] = []
        size = 0

        def flush() -> None:
            nonlocal sink, in_file, held, docs, size
            if sink is None:
                name = f"part-{self.job}-{uuid.uuid4().hex}.tids"
                system.create_dir(root, recursive=True)
                sink, in_file = system.open_output_stream(f"{root}/_{name}", compression=None), 0
                files.append((name, 0))
            sink.write(pack_segment(np.concatenate(held), docs, self.params.block_ids))
            in_file += size
            files[-1] = (files[-1][0], in_file)
            held, docs, size = [], [], 0

        try:
            for batch in iterator:
                names, texts = batch.column("id").to_pylist(), batch.column("text")
                first = 0
                while first < batch.num_rows:
                    last, chars = first, 0
                    while last < batch.num_rows and chars < 4 << 20:
                        chars += len(texts[last].as_buffer())
                        last += 1
                    for name, ids in zip(names[first:last], encoder.encode(texts.slice(first, last - first).to_pylist())):
                        ids = np.append(ids, np.uint16(self.params.end_id))
                        at, count = 0, len(ids)
                        more = False
                        while count:
                            part = min(count, self.params.segment_ids - size)
                            held.append(ids[at : at + part])
                            docs.append((name, part, more))
                            at, count, size, more = at + part, count - part, size + part, True
                            if size == self.params.segment_ids:
                                flush()
                        if sink is not None and in_file + size >= self.params.file_ids:  # a file ends with a whole document
                            if size:
                                flush()
                            sink.close()
                            sink = None
                    first = last
            if size:
                flush()
        finally:
            if sink is not None:
                sink.close()
        return _Written(TaskContext.get().partitionId(), tuple(files))

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        before, listed = 0, []
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, count in message.files:
                system.move(f"{root}/_{name}", f"{root}/{name}")
                listed.append({"name": name, "before": before})
                before += count
        with system.open_output_stream(f"{root}/_manifest.json") as sink:
            sink.write(json.dumps({"files": listed, "ids": before}).encode())
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
    before: int


class TokenReader(DataSourceReader):
    """Documents of the files that the manifest lists: id, ids before it, number of ids, ids (32-bit)."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        system, root = _filesystem(self.path)
        with system.open_input_stream(f"{root}/_manifest.json") as source:
            listed = json.loads(source.read())["files"]
        return [_File(f["name"], f["before"]) for f in listed] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _filesystem(self.path)
        start, rows, held = partition.before, [], 0
        last: tuple | None = None
        parts: list[bytes] = []

        def close() -> None:
            nonlocal start, held, last, parts
            raw = b"".join(parts)
            rows.append((last[0], start, len(raw) // 4, raw))
            start, held, parts = start + len(raw) // 4, held + len(raw), []

        with system.open_input_stream(f"{root}/{partition.name}", compression=None, buffer_size=1 << 20) as source:
            while not (segment := Segment(source)).at_end:
                raw = memoryview(segment.ids().tobytes())
                at = 0
                for flag, name, count in zip(segment.flags.tolist(), segment.names.tolist(), segment.lengths.tolist()):
                    if not flag & _MORE:
                        if last is not None:
                            close()
                        last = (None if flag & _NULL else name,)
                        if held >= 8 << 20:
                            yield _batch(rows)
                            rows.clear()
                            held = 0
                    parts.append(bytes(raw[at : at + 4 * count]))
                    at += 4 * count
        if last is not None:
            close()
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "start", "n_tokens", "ids"]
    )


class TokenDataSource(DataSource):
    """``spark.read.format("token_ids").load(path)``; written by :func:`write_tokens`."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return TOKENS

    def reader(self, schema: T.StructType) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        known = TokenParams()
        given = {k: type(getattr(known, k))(self.options[k]) for k in TokenParams.__dataclass_fields__ if k in self.options}
        return TokenWriter(self.options["path"], TokenParams(**given))


def register_tokens(spark: SparkSession) -> None:
    """Make the ``token_ids`` format known to a session."""
    spark.dataSource.register(TokenDataSource)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", params: TokenParams = TokenParams()) -> None:
    """Write the token ids of all documents below ``path`` in ascending order of their ids."""
    spark = docs.sparkSession
    short_batches(spark)
    register_tokens(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("place")]
    laid = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    options = {name: str(getattr(params, name)) for name in TokenParams.__dataclass_fields__}
    laid.select("id", "text").write.format("token_ids").options(**options).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of the documents below ``path``; ids are little-endian unsigned 32-bit integers."""
    register_tokens(spark)
    return spark.read.format("token_ids").load(path)


def coded_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: TokenParams = TokenParams()) -> DataFrame:
    """Documents written as token files in the shared folder and read back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, params)
    return read_tokens(docs.sparkSession, path).withColumnRenamed("id", id_col)
