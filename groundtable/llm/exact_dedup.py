"""Exact deduplication over an extendible-hash index on shared files.

The 64-bit hash of the normalised text is the key.  A directory maps its leading bits to buckets;
a bucket above its capacity splits in two, and the directory doubles when that bucket already uses
all directory bits.  Owner tasks each take a contiguous range of buckets in key order, chain the
entries of equal hash, compare their bytes and write the range's index pages to the shared folder.

* Null text counts as the empty string.  Texts are equal when identical after every run of
  ``[\\x20\\x09-\\x0D]`` becomes one space.
* The row with the smallest id of a group stays; null ids rank behind all others.  Rows that repeat
  both id and text get the same verdict.
* An empty table gives an empty result.  Other columns of the input are ignored, whatever their names.
* Of texts of any length only a digest leaves the task that compares their bytes.
* A text that a third of all rows share reaches its owner once per Arrow batch, not once per row,
  and the owner streams the sorted entries, so its memory does not grow with the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtable.plans.shared import short_batches, shuffle_width, spill

SPACES = r"[\x20\x09-\x0D]+"


class Directory:
    """An extendible-hash directory over key prefixes of at most ``max_depth`` bits."""

    def __init__(self, capacity: int, max_depth: int):
        self.capacity, self.max_depth = capacity, max_depth
        self.depth = 0
        self.slots = [(0, 0)]  # the bucket (prefix, local depth) of each slot

    def _double(self) -> None:
        self.slots = [bucket for bucket in self.slots for _ in range(2)]
        self.depth += 1

    def _split(self, prefix: int, local: int) -> list[tuple[int, int]]:
        if local == self.depth:
            self._double()
        halves = [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)]
        width = 1 << (self.depth - local)
        first = prefix * width
        self.slots[first : first + width] = [halves[0]] * (width // 2) + [halves[1]] * (width // 2)
        return halves

    def load(self, weights: dict[int, int]) -> Directory:
        """Split until no bucket exceeds its capacity; ``weights`` holds bytes by full-depth prefix."""
        total = [0]
        for prefix in range(1 << self.max_depth):
            total.append(total[-1] + weights.get(prefix, 0))
        pending = [(0, 0)]
        while pending:
            prefix, local = pending.pop()
            span = 1 << (self.max_depth - local)
            if local < self.max_depth and total[(prefix + 1) * span] - total[prefix * span] > self.capacity:
                pending += self._split(prefix, local)
        return self

    def rows(self, weights: dict[int, int], owners: int) -> list[tuple[int, int, int]]:
        """(slot, bucket number, owner): buckets in key order, cut into ranges of similar weight."""
        shift = self.max_depth - self.depth
        by_slot = [0] * len(self.slots)
        for prefix, weight in weights.items():
            by_slot[prefix >> shift] += weight
        whole, seen, number, out, owner = max(1, sum(by_slot)), 0, -1, [], 0
        for slot, bucket in enumerate(self.slots):
            if slot == 0 or bucket != self.slots[slot - 1]:
                number += 1
                owner = min(owners - 1, seen * owners // whole)
            seen += by_slot[slot]
            out.append((slot, number, owner))
        return out


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct text of a batch, found by its bytes."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        grouped = table.group_by(["key", "body"], use_threads=False).aggregate(
            [("digest", "first"), ("id", "min"), ("rows", "sum")]
        )
        yield from grouped.select(["key", "body", "digest_first", "id_min", "rows_sum"]).rename_columns(
            ["key", "body", "digest", "id", "rows"]
        ).to_batches()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the entries of each hash, comparing bytes; the input is sorted by bucket and hash."""
    fields = ("bucket", "key", "chain", "digest", "keep_id", "group_size")
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    bucket = key = None
    chain: list[list] = []
    out: list[tuple] = []

    def close() -> None:
        out.extend((bucket, key, place, digest, low, rows) for place, (_, digest, low, rows) in enumerate(chain))

    def page() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(fields)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)
        out.clear()
        return made

    for batch in batches:
        columns = [batch.column(name) for name in ("bucket", "key", "body", "digest", "id", "rows")]
        numbers, keys, _, _, ids, counts = (c.to_pylist() if i != 2 else None for i, c in enumerate(columns))
        bodies, digests = columns[2], columns[3]
        for row in range(batch.num_rows):
            if keys[row] != key or bucket is None:
                close()
                bucket, key, chain = numbers[row], keys[row], []
            body, low, rows = bodies[row].as_py(), ids[row], counts[row]
            for entry in chain:
                if entry[0] == body:
                    entry[2] = low if entry[2] is None else entry[2] if low is None else min(entry[2], low)
                    entry[3] += rows
                    break
            else:
                chain.append([body, digests[row].as_py(), low, rows])
        if len(out) >= 20_000:
            yield page()
    close()
    yield page()


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity_bytes: int = 64 << 20,
    most_depth: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Build the index; returns (entries: one row per document, pages: one row per distinct text).

    The directory is planned from prefix weights of some sixteen prefixes a bucket, at most
    ``2**most_depth`` of them.  There are as many owners as buckets' worth of bytes.
    """
    spark = docs.sparkSession
    short_batches(spark)
    body = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
    keyed = rows.select("id", "body", F.xxhash64("body").alias("key"), F.unhex(F.sha2("body", 256)).alias("digest"))
    entries = spill(keyed.select("id", "key", "digest", F.octet_length("body").alias("n_bytes")), "entries")

    total = entries.agg(F.sum(F.col("n_bytes") + 64)).first()[0] or 0
    max_depth = min(most_depth, max(4, (16 * total // capacity_bytes).bit_length()))
    prefix = F.shiftrightunsigned("key", 64 - max_depth)
    weights = {
        row[0]: row[1] for row in entries.groupBy(prefix.alias("p")).agg(F.sum(F.col("n_bytes") + 64)).collect()
    }
    directory = Directory(capacity_bytes, max_depth).load(weights)
    owners = max(shuffle_width(spark), -(-total // capacity_bytes))
    slots = spark.createDataFrame(directory.rows(weights, owners), "slot long, bucket int, owner int")

    typed = keyed.select("key", F.col("body").cast("binary").alias("body"), "digest", "id", F.lit(1).cast("long").alias("rows"))
    combined = typed.mapInArrow(_combine, "key long, body binary, digest binary, id long, rows long")
    slot = F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
    owned = (
        combined.withColumn("slot", slot)
        .join(F.broadcast(slots), "slot")  # at most 2**most_depth rows
        .repartitionById(owners, "owner")
        .sortWithinPartitions("bucket", "key")
    )
    columns = ["bucket", "key", "body", "digest", "id", "rows"]
    pages = owned.select(*columns).mapInArrow(
        _own, "bucket int, key long, chain int, digest binary, keep_id long, group_size long"
    )
    return entries, spill(pages, "pages")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    entries, pages = exact_groups(docs, id_col, text_col, **index)
    shared = pages.where("group_size > 1").select("key", "digest", "keep_id", "group_size")
    joined = entries.join(shared, ["key", "digest"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep, F.col("id").isNull() & keep.isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
