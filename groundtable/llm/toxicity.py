"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, adjacent word pairs and pairs that skip one
word.  Words are runs of ASCII letters, digits and non-ASCII bytes; ASCII is lower-cased.  Training
runs in one task on at most ``max_rows`` labelled rows, taken by a hash of the id; per-coordinate
rates and the L1 term leave few weights different from zero, and only those are broadcast.

* Null text counts as empty; an empty text scores the model's base rate.
* Rows with a null label are not learnt from.  Ties of the sampling hash go by id.
* Without any labelled row the model scores 0 for every text.
* Very long texts are read in parts; what is held of them is some words' worth of hashes.
* Rows that repeat an id are scored each for itself, and learnt from each with the id's label.
* Scoring is a column function: all columns and rows of the input stay, whatever their names.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtable.llm.byte_hash import FIELD_LOWER_CODES, IS_ALNUM, mix, utf8_parts, word_hashes
from groundtable.plans.shared import short_batches

BITS = 20
_SLOTS = 1 << BITS


@dataclass(frozen=True)
class FtrlParams:
    """Rates of the FTRL-proximal learner; ``max_rows`` bounds the labelled sample.

    A share ``calibration`` of the sample is kept from the learner and fits the logit's scale and
    offset, since the L1 term pulls the scores of rarely seen words towards the base rate.
    """

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2.5
    l2: float = 0.5
    epochs: int = 3
    max_rows: int = 16_000
    calibration: float = 0.25


def _features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs in row order; ``wanted`` keeps only slots marked true."""
    words, rows = word_hashes(data, offsets, IS_ALNUM, FIELD_LOWER_CODES)
    found_rows, found_slots = [rows], [mix(words + np.uint64(1))]
    for gap in (1, 2):
        near = rows[gap:] == rows[:-gap]
        pair = mix(words[:-gap] * np.uint64(2 * gap + 1) + np.uint64(gap)) + words[gap:]
        found_rows.append(rows[gap:][near])
        found_slots.append(mix(pair[near]))
    row = np.concatenate(found_rows)
    slot = (np.concatenate(found_slots) >> np.uint64(64 - BITS)).astype(np.int64)
    if wanted is not None:
        keep = wanted[slot]
        row, slot = row[keep], slot[keep]
    pairs = np.unique((row << BITS) | slot)
    return pairs >> BITS, pairs & (_SLOTS - 1)


def _trainer(params: FtrlParams):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, labels = [], []
        for batch in batches:
            label = batch.column("label").to_pylist()
            for first, last, data, offsets in utf8_parts(batch.column("text")):
                rows, slots = _features(data, offsets)
                cuts = np.searchsorted(rows, np.arange(last - first + 1))
                examples += [slots[cuts[i] : cuts[i + 1]].astype(np.int32) for i in range(last - first)]
                labels += label[first:last]
        z, n = np.zeros(_SLOTS + 1), np.zeros(_SLOTS + 1)
        bias = np.array([_SLOTS], dtype=np.int32)
        order = np.random.RandomState(params.epochs).permutation(len(examples))
        apart, learnt = np.split(order, [int(params.calibration * len(order))])
        for epoch in range(params.epochs):
            for i in np.random.RandomState(epoch).permutation(learnt):
                at = np.concatenate([examples[i], bias])
                zi, ni = z[at], n[at]
                w = _weights(zi, ni, params, penalised=slice(0, -1))
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / params.alpha * w
                n[at] = ni + g * g
        w = _weights(z, n, params, penalised=slice(0, -1))
        if len(apart):
            logits = np.array([w[examples[i]].sum() + w[-1] for i in apart])
            scale, offset = _calibrate(logits, np.array([labels[i] for i in apart]))
            w = w * scale
            w[-1] += offset
        at = np.flatnonzero(w) if len(examples) else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], ["slot", "weight"])

    return train


def _calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with targets drawn in from 0 and 1 by the class counts."""
    ones = labels.sum()
    if ones == 0 or ones == len(labels):
        return 1.0, 0.0
    targets = np.where(labels > 0.5, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([logits, np.ones(len(logits))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(theta @ x, -35, 35)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - targets) + 1e-3 * (theta - np.array([1.0, 0.0])))
        theta = theta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def _weights(z: np.ndarray, n: np.ndarray, params: FtrlParams, penalised: slice) -> np.ndarray:
    """The closed-form proximal weights; the last coordinate (the base rate) carries no L1 term."""
    l1 = np.zeros(len(z))
    l1[penalised] = params.l1
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    return -shrunk / ((params.beta + np.sqrt(n)) / params.alpha + params.l2)


def held_out(id_col: Column) -> Column:
    """True for rows that are never learnt from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    params: FtrlParams = FtrlParams(),
) -> tuple[np.ndarray, np.ndarray]:
    """Learn from labelled rows that are not held out; returns (slots, weights), at most 2**20 of them."""
    short_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    sample = (
        known.where(F.col("label").isNotNull() & ~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id")
        .limit(params.max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("text", "label", "id")  # at most max_rows rows
    model = (
        rows.repartition(1)
        .sortWithinPartitions("id", "text")
        .mapInArrow(_trainer(params), "slot int, weight double")
        .toArrow()
    )
    return model["slot"].to_numpy(), model["weight"].to_numpy()


def toxicity_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> Column:
    """The column of scores in [0, 1] of a text column under a trained model."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        slots, weights = shared.value
        dense = np.zeros(_SLOTS + 1)
        dense[slots] = weights
        wanted = dense[:-1] != 0
        out = np.full(len(texts), dense[-1])
        for first, last, data, offsets in utf8_parts(texts):
            rows, found = _features(data, offsets, wanted)
            out[first:last] += np.bincount(rows, weights=dense[found], minlength=last - first)
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))) if len(slots) else np.zeros(len(texts)))

    return score(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    params: FtrlParams = FtrlParams(),
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from 0.5 on)."""
    model = train_toxicity(docs, labels, id_col, text_col, label_col, params)
    scored = docs.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), toxicity_score(docs, model, text_col).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
