"""Removal of long repeated passages with run-length indexes.

A byte goes when it is covered by a string of ``window`` bytes that starts anywhere else too, in the
same text or another.  Where a repeat can lie is found by content, so the corpus splits into small
indexes that together see every repeat:

1. Every window of ``window`` bytes has an anchor: the least hash of a ``gram``-byte string in it,
   leftmost on ties.  Equal windows have equal anchors.  Consecutive windows with the same anchor
   form an occurrence of it, with the bytes that those windows cover as its context.
2. An anchor that occurs once is followed no further.  Occurrences with equal anchor and context (by a
   128-bit digest of the context's bytes beside the anchor's hash) are one string of the index with a
   count, and repeated in full.  Counts are summed on the map side.
3. The distinct contexts of an anchor, one occurrence of each, go to a run-length index
   (:mod:`groundtable.llm.run_index`): a run-compressed Burrows-Wheeler transform whose sampled run
   ends give the matching statistics of all positions in one pass; statistics of ``window`` or more
   mark repeats.  An index takes whole anchors up to ``index_bytes``.  An anchor with ``many``
   contexts is split by the bytes that follow or precede it: a repeat reaches half of the rest of
   the window to one side, so it meets its like in one of the two.
4. An anchor with more than ``swarm`` contexts (a passage that a great share of all texts holds, each with
   other surroundings) would still make one index of them all.  The windows of its contexts are counted
   instead, by 128-bit digests, summed on the map side, so no task gets them all.

* Text is taken as UTF-8 bytes, null as empty; matches never cross texts.
* A row goes by its id; a row without one, or whose id another row has too, goes by 62 bits of a SHA-256 of
  id and text, so it keeps spans of its own.  Rows that repeat id and text count as two texts, each a repeat
  of the other.
* An empty table gives an empty result; texts shorter than the window stay whole.
* Input columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtable.llm.byte_hash import SpanHasher, utf8_parts
from groundtable.llm.id_filter import mark_ids, marked, passes
from groundtable.llm.run_index import repeated_windows
from groundtable.plans.shared import short_batches, shuffle_width, spill

_SLICE = 8 << 20  # window starts of one slice of a very long text
_PLACE = np.uint64((1 << 24) - 1)
OCCURRENCE = "anchor long, context long, check long, id long, low long, high long"
_INDEX_TASK = 32 << 20  # bytes of contexts that one task should get


@dataclass(frozen=True)
class RepeatParams:
    """More than ``many`` contexts of one anchor make it split, more than ``swarm`` make its windows counted."""

    window: int = 200
    gram: int = 48
    index_bytes: int = 2 << 20
    many: int = 2048
    swarm: int = 32_768
    filter_bits: int = 26


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _occurrences(data: np.ndarray, offsets: np.ndarray, params: RepeatParams):
    """(row, first window, last window, anchor hash, place in the data) of the anchors of some texts."""
    window, gram = params.window, params.gram
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return empty, empty, empty, empty, empty
    hasher = SpanHasher(data)
    at = np.arange(len(data) - gram + 1)
    hashes = hasher.spans(at, at + gram)
    ranked = (hashes & ~_PLACE) | at.astype(np.uint64)
    anchor = (_least(ranked, window - gram + 1) & _PLACE).astype(np.int64)  # for each window start
    last_start = offsets[1:] - window
    inside = np.zeros(len(anchor) + 1, dtype=np.int64)
    long = np.flatnonzero(last_start >= offsets[:-1])
    inside[offsets[:-1][long]] += 1
    inside[last_start[long] + 1] -= 1
    valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(valid):
        return empty, empty, empty, empty, empty
    own = anchor[valid]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first = np.flatnonzero(new)
    low, high = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    rows = np.searchsorted(offsets, low, side="right") - 1
    return rows, low - offsets[rows], high - offsets[rows], hashes[own[first]].view(np.int64), low


def _pieces(array: pa.Array, params: RepeatParams):
    """Runs of whole texts, and very long texts in slices that overlap by a window: (rows, shift, bytes, offsets)."""
    for first, last, data, offsets in utf8_parts(array, 1 << 20):
        if len(data) <= _SLICE + params.window:
            yield np.arange(first, last), 0, data, offsets
            continue
        for start in range(0, len(data) - params.window + 1, _SLICE):
            part = data[start : start + _SLICE + params.window - 1]
            yield np.array([first]), start, part, np.array([0, len(part)])


def _anchors(params: RepeatParams):
    """The anchor of every occurrence, nothing else."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _pieces(batch.column("text"), params):
                yield pa.RecordBatch.from_arrays([pa.array(_occurrences(data, offsets, params)[3])], ["anchor"])

    return scan


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of byte ranges, as two integers each."""
    view = memoryview(data)
    found = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _scan(params: RepeatParams):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for numbers, shift, data, offsets in _pieces(batch.column("text"), params):
                rows, low, high, anchors, at = _occurrences(data, offsets, params)
                contexts = _digests(data, at, at + high - low + params.window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors), pa.array(contexts[:, 0]), pa.array(contexts[:, 1]), ids.take(pa.array(numbers[rows])),
                        pa.array(low + shift), pa.array(high + shift),
                    ],
                    ["anchor", "context", "check", "id", "low", "high"],
                )

    return scan


def _pass_marked(bitmap: Broadcast):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(marked(batch.column("id"), bitmap.value)))

    return keep


def _cut_contexts(params: RepeatParams):
    """The bytes of each wanted context, and hashes of what surrounds its anchor where long enough."""
    half = (params.window - params.gram + 1) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column("text")):
                body = text.as_buffer()
                view = memoryview(body)
                for want in batch.column("wanted")[i].as_py():
                    piece = bytes(view[want["low"] : want["high"] + params.window])
                    data = np.frombuffer(piece, dtype=np.uint8)
                    at = int(_anchor_place(data, params))
                    around = SpanHasher(data).spans(
                        np.array([max(0, at - half), min(at + params.gram, len(data))]), np.array([at, min(at + params.gram + half, len(data))])
                    ).view(np.int64)
                    out.append(
                        (
                            want["anchor"], want["many"], batch.column("id")[i].as_py(), want["low"], piece,
                            int(around[0]) if at >= half else None, int(around[1]) if len(data) - at - params.gram >= half else None,
                        )
                    )
            columns = list(zip(*out)) or [()] * 7
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "many", "id", "low", "bytes", "left", "right"]
            )

    return cut


def _anchor_place(data: np.ndarray, params: RepeatParams) -> int:
    """Where the anchor of the first window of a context lies."""
    at = np.arange(params.window - params.gram + 1)
    hashes = SpanHasher(data[: params.window]).spans(at, at + params.gram)
    return int((((hashes & ~_PLACE) | at.astype(np.uint64)).min()) & _PLACE)


def _match(params: RepeatParams):
    """Repeated windows within indexes of whole groups; the input is sorted by side and group."""

    def index(held: list[tuple]) -> pa.RecordBatch:
        number, low, high = repeated_windows([h[2] for h in held], params.window)
        shift = np.array([h[1] for h in held], dtype=np.int64)[number]
        ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(number))
        return pa.RecordBatch.from_arrays([ids, pa.array(low + shift), pa.array(high + shift + params.window)], ["id", "start", "end"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, side, group = 0, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("side", "group", "id", "low", "bytes")]
            for s, g, doc, low, piece in zip(*columns):
                if held and (s != side or g != group and size >= params.index_bytes):
                    yield index(held)
                    held, size = [], 0
                side, group = s, g
                held.append((doc, low, piece))
                size += len(piece)
        if held:
            yield index(held)

    return match


def _count_windows(params: RepeatParams):
    """A digest and the place of each window of the contexts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, doc, low in zip(batch.column("bytes"), batch.column("id"), batch.column("low").to_pylist()):
                data = np.frombuffer(piece.as_buffer(), dtype=np.uint8)
                at = np.arange(len(data) - params.window + 1)
                found = _digests(data, at, at + params.window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array([doc.as_py()] * len(at), pa.int64()), pa.array(at + low)],
                    ["digest", "check", "id", "start"],
                )

    return windows


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """(own_id, id, text): the id as given, a key that tells different rows apart, and the bytes."""
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    shared = spill(docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared-ids")
    again = F.col("own_id").isNull()
    if not shared.isEmpty():
        bitmap = docs.sparkSession.sparkContext.broadcast(mark_ids(shared, params.filter_bits))

        @F.arrow_udf("boolean")
        def may_be_shared(ids: pa.Array) -> pa.Array:
            return pa.array(passes(ids, bitmap.value))

        again = again | may_be_shared("own_id")
    name = F.concat(F.coalesce(F.col("own_id").cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.col("text"))
    far = F.lit(1 << 62) + F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long")
    return texts.select("own_id", F.when(again, far).otherwise(F.col("own_id")).alias("id"), "text")


def repeated_spans(texts: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """(id, start, end) byte ranges of ``texts`` (id, text) that repeat; ranges of a text may overlap and come in any order."""
    spark = texts.sparkSession
    short_batches(spark)
    # stored first, so that the join has exchanges of its own and a very frequent anchor can be split
    anchors = texts.select("text").mapInArrow(_anchors(params), "anchor long")
    scanned = texts.select("id", "text").mapInArrow(_scan(params), OCCURRENCE)
    repeated = spill(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    again = spill(scanned.join(repeated, "anchor", "left_semi"), "occurrences")

    classes = spill(
        again.groupBy("anchor", "context", "check").agg(F.count("*").alias("n"), F.min(F.struct("id", "low", "high")).alias("one")), "contexts"
    )
    full = again.join(classes.where("n > 1").select("anchor", "context", "check"), ["anchor", "context", "check"], "left_semi")
    whole = full.select("id", F.col("low").alias("start"), (F.col("high") + params.window).alias("end"))

    unequal = (
        classes.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
        .where("contexts > 1 AND least = 1")
        .select("anchor", (F.col("contexts") > params.many).alias("many"), (F.col("contexts") > params.swarm).alias("swarm"))
    )
    wanted = spill(
        classes.join(unequal, "anchor").select("anchor", "many", "swarm", "one.id", "one.low", "one.high"), "wanted"
    )
    bitmap = spark.sparkContext.broadcast(mark_ids(wanted, params.filter_bits))

    def contexts(rows: DataFrame) -> DataFrame:
        by_text = rows.groupBy("id").agg(F.collect_list(F.struct("anchor", "many", "low", "high")).alias("wanted"))
        holders = texts.select("id", "text").mapInArrow(_pass_marked(bitmap), "id long, text binary").join(by_text, "id").dropDuplicates(["id"])
        return holders.select("id", "text", "wanted").mapInArrow(
            _cut_contexts(params), "anchor long, many boolean, id long, low long, bytes binary, left long, right long"
        )

    pieces = contexts(wanted.where("NOT swarm"))
    size = wanted.agg(F.sum(F.col("high") - F.col("low") + params.window + 64)).first()[0] or 0
    width = max(shuffle_width(spark), -(-2 * size // _INDEX_TASK))
    routes = F.when(
        F.col("many"),
        F.array_compact(
            F.array(
                F.when(F.col("left").isNotNull(), F.struct(F.lit(1).alias("side"), F.xxhash64("anchor", "left").alias("group"))),
                F.when(F.col("right").isNotNull(), F.struct(F.lit(2).alias("side"), F.xxhash64("anchor", "right").alias("group"))),
            )
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.xxhash64("anchor").alias("group"))))
    routed = (
        pieces.withColumn("route", F.explode(routes))
        .select("route.side", "route.group", "id", "low", "bytes")
        .repartition(width, "side", "group")
        .sortWithinPartitions("side", "group", "id", "low")
    )
    matched = routed.mapInArrow(_match(params), "id long, start long, end long")
    spans = whole.unionByName(matched)
    if not wanted.where("swarm").isEmpty():
        windows = spill(contexts(wanted.where("swarm")).mapInArrow(_count_windows(params), "digest long, check long, id long, start long"), "windows")
        often = windows.groupBy("digest", "check").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        counted = windows.join(often, ["digest", "check"], "left_semi")
        spans = spans.unionByName(counted.select("id", "start", (F.col("start") + params.window).alias("end")))
    return spill(spans, "spans")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length, removed bytes, number of maximal removed runs and digest of the rest, for each text."""
    for batch in batches:
        out = []
        starts, ends = batch.column("starts"), batch.column("ends")
        for i, text in enumerate(batch.column("text")):
            body = memoryview(text.as_buffer())
            digest, removed, runs, at = hashlib.sha256(), 0, 0, 0
            if starts[i].is_valid:
                a = starts[i].values.to_numpy()
                order = np.argsort(a, kind="stable")
                a = a[order]
                b = np.maximum.accumulate(ends[i].values.to_numpy()[order])
                first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                for low, high in zip(a[first].tolist(), b[np.append(first[1:], len(b)) - 1].tolist()):
                    digest.update(body[at:low])
                    removed, runs, at = removed + high - low, runs + 1, high
            digest.update(body[at:])
            out.append((len(body), removed, runs, digest.hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """One row per text: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    texts = keyed_texts(docs, id_col, text_col, params)
    spans = repeated_spans(texts.select("id", "text"), params)
    by_text = spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    found = texts.join(by_text, "id", "left").select(F.col("own_id").alias("id"), "text", "starts", "ends")
    return found.mapInArrow(_merge, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
