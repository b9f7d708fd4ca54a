"""Importance resampling towards a target corpus, over hashed word n-grams.

Texts are read as words of letters, digits and non-ASCII characters, A-Z lower-cased, joined by one
blank.  Each text so normalised is scanned once for its running CRCs (:mod:`groundtable.llm.crc_prefix`);
the CRC-32 of every run of up to ``most`` words follows from two of them, and its bucket is that CRC
modulo ``buckets``.  A bucket's gain compares its share of the target's features with its share of the
corpus's, both with one feature a bucket added.  A document's weight is the sum of gains over its
features; with Gumbel noise drawn from its id the highest scores are a sample without replacement in
proportion to exp(weight / 1000).

* Counts are summed per task, then by bucket: at most ``buckets`` rows leave a task.  The gains, one
  number a bucket, are all that is broadcast.
* Ranks come from a range-partitioned sort: places in each partition, and the sizes of the partitions
  before.  No task gets all rows; ties of score and id are told apart by the row's place, so that equal rows
  spread too.
* Null text counts as empty.  A null id draws as an empty string and ranks behind equal scores with an id.
  Rows that repeat an id are documents of their own; which of them stands first at equal score is by row.
* An empty table, or one without eligible documents, draws nothing; an empty target leaves gains of shares
  alone.  Texts are read whole, long ones in parts that share ``most`` - 1 words.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtable.llm.byte_hash import runs, utf8_parts
from groundtable.llm.crc_prefix import PrefixCrc
from groundtable.plans.shared import short_batches, shuffle_width, spill

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[~_WORD] = 32
_PART = 4 << 20  # bytes of a long text that are read at once
_OFFSET = (1 << 33) - 1


@dataclass(frozen=True)
class ImportanceParams:
    """N-grams of ``least`` to ``most`` words; ``percent`` of the documents of ``least_words`` words or more are drawn."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10


def _long_parts(data: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, words at their start that a part before has read) of a long text; parts end between words."""
    at, shared = 0, 0
    while at < len(data):
        end = at + _PART
        while end < len(data):
            gap = np.flatnonzero(~_WORD[data[end : end + _PART]])
            if len(gap):
                end += int(gap[0])
                break
            end += _PART
        end = min(end, len(data))
        yield data[at:end], shared
        if end == len(data):
            return
        starts, _, _ = runs(_WORD[data[at:end]], np.array([0, end - at]))
        keep = min(most - 1, len(starts))
        at, shared = (at + int(starts[-keep]), keep) if keep else (end, 0)


def _features(data: np.ndarray, offsets: np.ndarray, shared: int, params: ImportanceParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram whose last word is not among the first ``shared``, and the row of every new word."""
    starts, ends, rows = runs(_WORD[data], offsets)
    kept = _WORD[data]
    kept[ends[ends < len(data)]] = True  # one separator a word; at the end of a row it may be a byte of the next
    place = np.cumsum(kept) - kept
    low = place[starts]
    high = low + (ends - starts)
    crc = PrefixCrc(_NORMAL[data[kept]])
    buckets, owners = [], []
    for size in range(params.least, params.most + 1):
        first = np.arange(max(0, shared - size + 1), max(0, len(starts) - size + 1))
        first = first[rows[first] == rows[first + size - 1]]
        buckets.append(crc.spans(low[first], high[first + size - 1]) % np.uint32(params.buckets))
        owners.append(rows[first])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), rows[shared:]


def _parts(texts: pa.Array, params: ImportanceParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, buckets, rows of the buckets, rows of the words); a long text comes in several parts."""
    for first, last, data, offsets in utf8_parts(texts, 1 << 20):
        if len(data) <= _PART:
            yield first, last - first, *_features(data, offsets, 0, params)
            continue
        for part, shared in _long_parts(data, params.most):
            yield first, 1, *_features(part, np.array([0, len(part)]), shared, params)


def _count(params: ImportanceParams):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(params.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, buckets, _, _ in _parts(batch.column("text"), params):
                totals += np.bincount(buckets, minlength=params.buckets)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    return count


def _weigh(gains: Broadcast, params: ImportanceParams):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = gains.value
        for batch in batches:
            found = np.zeros((3, batch.num_rows), dtype=np.int64)  # features, words, weight
            for first, size, buckets, rows, words in _parts(batch.column("text"), params):
                order = np.argsort(rows, kind="stable") if params.most > params.least else slice(None)
                running = np.concatenate([[0], np.cumsum(worth[buckets[order]])])
                bounds = np.searchsorted(rows[order], np.arange(size + 1))
                part = found[:, first : first + size]
                part[0] += np.diff(bounds)
                part[1] += np.bincount(words, minlength=size)
                part[2] += np.diff(running[bounds])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found)], ["id", "n_features", "n_words", "weight"])

    return weigh


def _text(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")


def bucket_counts(texts: DataFrame, text_col: str = "text", params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    short_batches(texts.sparkSession)
    counted = texts.select(_text(texts, text_col)).mapInArrow(_count(params), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of corpus and target."""
    spark = corpus.sparkSession
    all_buckets = spark.range(params.buckets).select(F.col("id").alias("bucket"))
    both = (
        all_buckets.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    )
    of_corpus, of_target = ((df.agg(F.sum("n")).first()[0] or 0) + params.buckets for df in (corpus, target))
    ratio = (F.col("t") + 1) * F.lit(float(of_corpus)) / ((F.col("s") + 1) * F.lit(float(of_target)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def ranked(rows: DataFrame, eligible: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``: 1, 2, 3... in ``order`` over the rows where ``eligible``, behind them the others."""
    spark = rows.sparkSession
    keys = [(~eligible).asc(), *order]
    laid = rows.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    stored = spill(laid.withColumn("at", F.monotonically_increasing_id()), "ranked")
    sizes = stored.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    before, offsets = 0, []
    for size in sizes:
        offsets.append((size["part"], before))
        before += size["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    placed = stored.join(starts, F.shiftright("at", 33) == F.col("part"))
    return placed.withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit(_OFFSET)) + 1).drop("at", "part", "before")


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", params: ImportanceParams = ImportanceParams()
) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank): one row a document; rank is null where it is not drawn."""
    spark = docs.sparkSession
    counts = spill(bucket_counts(docs, text_col, params), "corpus-buckets")
    gains = np.zeros(params.buckets, dtype=np.int64)
    aims = spill(bucket_counts(target, target_col, params), "target-buckets")
    for row in bucket_gains(counts, aims, params).collect():  # one row a bucket
        gains[row["bucket"]] = row["gain"]
    shared = spark.sparkContext.broadcast(gains)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _text(docs, text_col))
    weighed = texts.mapInArrow(_weigh(shared, params), "id long, n_features long, n_words long, weight long")
    name = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")
    scores = spill(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scores")
    eligible = F.col("n_words") >= params.least_words
    wanted = params.percent * scores.where(eligible).count() // 100
    placed = ranked(scores, eligible, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()])
    rank = F.when(eligible & (F.col("place") <= wanted), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", rank.alias("rank"))
