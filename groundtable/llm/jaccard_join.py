"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact array intersection.

A document's set holds the 64-bit hashes of its distinct word shingles (words are runs of
``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; a document with fewer words is one shingle).  Two documents
link when ``den * intersection >= num * union``.  Links are found in this order:

1. Documents with equal sets form a class and one of them, the smallest id, stands for it.
2. Each representative lists the rarest part of its set, just long enough that two linked documents
   share an entry, so documents meet only in the tile of a shared entry.  Any common order of
   entries keeps this exact; the one by document counts keeps tiles small.
3. Every document is compared with one other: of the first documents of its tiles, cut by size
   band, the one that it meets most often.  This joins large groups of near copies with one
   comparison each instead of all pairs.
4. In tiles that still hold several components, each document outside the largest component is
   compared with all documents of other components whose sizes allow a link.  Nothing is capped, so no component is split.

A comparison first checks sizes and the places of a shared entry in both lists, then parity
signatures, folded to 1024 bits and then whole, of half as many bits as entries for large sets: bits in which two signatures differ come from shingles
that only one set has.  Both bound the overlap from above.  Pairs that pass have their sorted arrays
intersected.

Words are hashed by polynomials over a prime field, which special strings do not make collide.

* Null text and texts without words have an empty set (size 0) and link with nothing.
* Rows that repeat an id are one document: of their sets the one with the least fingerprint counts, in
  all of these rows.  Rows without an id stand for themselves: one whose set equals that of a document
  is in that document's class and component, any other has no class and no component (null).
* A document that meets several others equally often (a tie) is first compared with the smallest id.
* Very long texts are read in parts; what is held of them is eight bytes a word.
* An empty table gives an empty result.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundtable.llm.byte_hash import FIELD_LOWER_CODES, IS_SPACE, mix, utf8_parts, word_hashes
from groundtable.llm.components import connected_components
from groundtable.llm.id_filter import mark_ids, marked
from groundtable.plans.shared import short_batches, spill

SIGNATURE_BITS = 1024
SKETCH_WORDS = 16  # of 64 bits
_PART = 1 << 19  # bytes of texts that are hashed at once


@dataclass(frozen=True)
class JaccardParams:
    """Links need ``den * intersection >= num * union`` over shingles of ``words`` words.

    ``rarity_bits`` sizes the table of document counts by hashed shingle that is broadcast, a byte a
    slot; counts below ``common_from`` are not told apart.  Both only change the order of entries.
    ``candidate_bits`` bounds, as a power of two, the filter on candidate documents.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    rarity_bits: int = 20
    common_from: int = 16
    candidate_bits: int = 26


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, rows = word_hashes(data, offsets, ~IS_SPACE, FIELD_LOWER_CODES)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    counts = np.diff(bounds)
    whole = np.full(len(hashes), np.uint64(words), dtype=np.uint64)
    last = len(hashes) - words + 1
    if last > 0:
        rolled = np.full(last, np.uint64(words), dtype=np.uint64)
        for i in range(words):
            rolled = mix(rolled * np.uint64(3) + hashes[i : i + last])
        whole[:last] = rolled
    out = []
    for row, count in enumerate(counts.tolist()):
        at = bounds[row]
        if count >= words:
            out.append(np.unique(whole[at : at + count - words + 1]))
        elif count:
            short = np.full(1, np.uint64(count), dtype=np.uint64)
            for i in range(count):
                short = mix(short * np.uint64(3) + hashes[at + i : at + i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit fingerprint of each set, as two integers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)


def _signature(entries: np.ndarray) -> bytes:
    """Parity of the number of entries hashed to each bit; the bits are half the set's size or more."""
    bits = SIGNATURE_BITS
    while bits * 2 < len(entries):
        bits *= 2
    counts = np.bincount((entries & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _sketch(signature: bytes) -> np.ndarray:
    """A signature folded to its least length, as integers."""
    bits = np.frombuffer(signature, dtype=np.int64)
    while len(bits) > SKETCH_WORDS:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _profile(words: int):
    """Rows of kind 0: a document's set size and fingerprint; of kind 1: a shingle's documents."""
    names = ["kind", "id", "n", "high", "low"]

    def common(sets: list[np.ndarray]) -> pa.RecordBatch:
        """Shingles of at least three of these sets, which are let go."""
        entries = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        sets.clear()
        entries.sort()
        first = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]])) if len(entries) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(entries)))
        often = counts >= 3
        found = entries[first[often]].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(found), np.int32)), pa.array(found), pa.array(counts[often].astype(np.int64)), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())],
            names,
        )

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, sets = batch.column("id"), []
            for _, _, data, offsets in utf8_parts(batch.column("text"), _PART):
                sets += _shingles(data, offsets, words)
            prints = _prints(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])],
                names,
            )
            held += sets
            size += sum(len(x) for x in sets)
            del sets
            if size >= 2_000_000:
                yield common(held)
                size = 0
        yield common(held)

    return profile


def _entries(params: JaccardParams, rarity: Broadcast):
    """Each row's fingerprint and signature, and the listed part of its set, rarest first."""
    shift = np.uint64(64 - params.rarity_bits)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for batch in batches:
            sets = []
            for _, _, data, offsets in utf8_parts(batch.column("text"), _PART):
                sets += _shingles(data, offsets, params.words)
            listed = []
            for s in sets:
                need = -(-params.num * len(s) // params.den)  # the least overlap of any link
                order = np.argsort(table[s >> shift], kind="stable")[: len(s) - need + 1] if len(s) else np.zeros(0, np.int64)
                listed.append(s[order].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int32)
            flat = np.concatenate(listed) if listed else np.zeros(0, dtype=np.int64)
            signatures = [_signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(_prints(sets)[:, 0]),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array([_sketch(x) for x in signatures], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["id", "high", "n", "signature", "sketch", "entries"],
            )

    return entries


def _whole_sets(words: int, wanted: Broadcast):
    """The full sorted set of each document that the candidate filter lets through."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(marked(batch.column("id"), wanted.value))
            texts = batch.column("text").take(rows)
            sets = []
            for _, _, data, offsets in utf8_parts(texts, _PART):
                sets += _shingles(data, offsets, words)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), pa.array(_prints(sets)[:, 0]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "high", "entries"],
            )

    return whole


@F.arrow_udf(T.IntegerType())
def _difference(left: pa.Array, right: pa.Array) -> pa.Array:
    """Number of bits in which two signatures differ; the longer one is folded to the shorter one's length."""
    out = []
    for x, y in zip(left, right):
        a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
        while len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        out.append(int(np.bitwise_count(a ^ b).sum()))
    return pa.array(out, pa.int32())


@F.arrow_udf(T.LongType())
def _overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted arrays."""
    out = []
    for i in range(len(left)):
        a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
        merged = np.sort(np.concatenate([a, b]), kind="stable")
        out.append(int((merged[1:] == merged[:-1]).sum()))
    return pa.array(out, pa.int64())


class _Links:
    """Checks candidate pairs over one table of documents."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, params: JaccardParams):
        self.texts, self.nodes, self.params = texts, nodes, params

    def least_overlap(self, n: Column, m: Column) -> Column:
        """The least intersection of two linked sets of these sizes."""
        return F.ceil((n + m) * self.params.num / (self.params.num + self.params.den))

    def may_link(self, n: str, i: str, m: str, j: str) -> Column:
        """Sizes allow a link, and so does what follows a shared entry at these places of both lists.

        It holds at the first shared entry of every linked pair.
        """
        sizes = F.least(n, m) * self.params.den >= F.greatest(n, m) * self.params.num
        rest = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
        return sizes & (rest >= self.least_overlap(F.col(n), F.col(m)))

    def near_sketches(self, n: str, a: str, m: str, b: str) -> Column:
        """The sketches differ in no more bits than the sets of a link may differ in entries."""
        differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)), F.lit(0))
        return differ <= F.col(n) + F.col(m) - 2 * self.least_overlap(F.col(n), F.col(m))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by signature bound and then by exact intersection."""
        side = self.nodes.select("id", "n", "signature")
        bounded = (
            pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
            .withColumn("differ", _difference("sa", "sb"))
            .where((F.col("na") + F.col("nb") - F.col("differ")) / 2 >= self.least_overlap(F.col("na"), F.col("nb")))
        )
        near = spill(bounded.select("a", "b", "na", "nb"), "near")
        ids = spill(near.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(self.nodes.select("id", "high"), "id"), "near-ids")
        wanted = self.texts.sparkSession.sparkContext.broadcast(mark_ids(ids, self.params.candidate_bits))
        whole = self.texts.mapInArrow(_whole_sets(self.params.words, wanted), "id long, high long, entries array<long>")
        sets = spill(whole.join(ids, ["id", "high"], "left_semi").dropDuplicates(["id", "high"]), "sets")
        checked = (
            near.join(sets.select(F.col("id").alias("a"), F.col("entries").alias("ea")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("entries").alias("eb")), "b")
            .withColumn("both", _overlap("ea", "eb"))
        )
        union = F.col("na") + F.col("nb") - F.col("both")
        return spill(checked.where(F.col("both") * self.params.den >= union * self.params.num).select("a", "b"), "links")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JaccardParams = JaccardParams()
) -> DataFrame:
    """One row per document: id, n_shingles, class_id (smallest id with an equal set), component_id."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    profiles = spill(
        texts.mapInArrow(_profile(params.words), "kind int, id long, n long, high long, low long"), "profiles"
    )
    rows = profiles.where("kind = 0").select("id", "n", "high", "low")
    one = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("high", "low", "n")).alias("set"), F.count("*").alias("rows"))
    documents = spill(one.select("id", "set.n", "set.high", "set.low", "rows"), "documents")
    slot = F.shiftrightunsigned("id", 64 - params.rarity_bits)
    counts = (
        profiles.where("kind = 1").groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).where(F.col("n") >= params.common_from)
        .select("slot", F.floor(F.log2("n")).cast("int").alias("class"))
        .toArrow()  # at most 2**rarity_bits rows
    )
    rarity = np.zeros(1 << params.rarity_bits, dtype=np.uint8)
    rarity[counts["slot"].to_numpy()] = counts["class"].to_numpy()

    classes = documents.where("n > 0").groupBy("high", "low", "n").agg(F.min("id").alias("class_id"))
    classes = spill(classes, "classes")
    listed = texts.mapInArrow(
        _entries(params, spark.sparkContext.broadcast(rarity)),
        "id long, high long, n long, signature binary, sketch array<long>, entries array<long>",
    )
    representatives = classes.select(F.col("class_id").alias("id"), "high")
    nodes = spill(listed.join(representatives, ["id", "high"], "left_semi").dropDuplicates(["id", "high"]), "nodes")
    links = _Links(texts, nodes, params)

    band = F.floor(F.log(F.col("n")) / float(max(np.log(params.den / params.num), 1e-6))).cast("int")
    tiles = nodes.select("id", "n", band.alias("band"), F.posexplode("entries").alias("place", "entry"))
    seen = tiles.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1")
    tiles = spill(tiles.join(seen.select("entry"), "entry", "left_semi"), "tiles")

    first = tiles.groupBy("entry", "band").agg(F.min(F.struct("id", "n", "place")).alias("first"))
    starred = tiles.join(first, ["entry", "band"]).select(
        "id", "n", "place", F.col("first.id").alias("to"), F.col("first.n").alias("m"), F.col("first.place").alias("j")
    )
    stars = starred.where("id != to").where(links.may_link("n", "place", "m", "j")).groupBy("id", "to").agg(F.count("*").alias("shared"))
    nearest = stars.groupBy("id").agg(F.max(F.struct("shared", (-F.col("to")).alias("to"))).alias("star"))
    edges = links.verified(nearest.select((-F.col("star.to")).alias("a"), F.col("id").alias("b")))
    components = connected_components(edges)

    placed = tiles.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    placed = spill(placed, "placed")
    parts = placed.groupBy("entry", "component").agg(F.count("*").alias("members"))
    mixed = (
        parts.groupBy("entry")
        .agg(F.count("*").alias("parts"), F.max(F.struct("members", "component"))["component"].alias("main"))
        .where("parts > 1")
    )
    open_tiles = placed.join(mixed.select("entry", "main"), "entry").join(nodes.select("id", "sketch"), "id")
    outer = open_tiles.where("component != main").select(
        "entry", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("sketch").alias("sa"), F.col("component").alias("ca")
    )
    inner = open_tiles.select(
        "entry", "main", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("sketch").alias("sb"), F.col("component").alias("cb")
    )
    rest = (
        outer.join(inner, "entry")
        .where("ca != cb AND (cb = main OR a < b)")
        .where(links.may_link("na", "pa", "nb", "pb") & links.near_sketches("na", "sa", "nb", "sb"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    edges = edges.unionByName(links.verified(rest))
    components = connected_components(edges).withColumnRenamed("node", "class_id")

    placed = (
        documents.join(classes, ["high", "low", "n"], "left")
        .withColumn("class_id", F.coalesce("class_id", "id"))
        .join(components, "class_id", "left")
        .withColumn("component", F.coalesce("component", "class_id"))
    )
    named = placed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("id", "n", "class_id", "component")
    nameless = (
        rows.where("id IS NULL").join(classes, ["high", "low", "n"], "left").join(components, "class_id", "left")
        .select("id", "n", "class_id", F.coalesce("component", "class_id").alias("component"))
    )
    found = named.unionByName(nameless)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "class_id",
        F.col("component").alias("component_id"),
    )
