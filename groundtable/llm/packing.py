"""Order-preserving packing of tokenised documents by dynamic programming.

The documents of an input partition form one token stream, in the order in which they come.  The
stream is cut into sequences of at most ``width`` tokens so that padding plus cut penalties is
least.  Cuts may fall at document ends (free), sentence ends, or inside a sentence (dearest).  A
sequence is padded to ``width`` unless its length is a power of two.

For a cut at position x the best earlier cut minimises ``cost + position`` over a sliding range, so
a monotone queue serves every transition in constant time: one queue for one sequence between two
boundaries, a second for two sequences whose inner cut falls inside a sentence after exactly
``width`` tokens.  Sentences longer than ``width`` get inner cut points every ``width`` tokens.

* Null text counts as empty; an empty text is the end token alone.
* No shuffle takes place: each task packs its own partition, in blocks of whole documents.
* Rows that repeat an id are packed as documents of their own.  An empty table gives no pieces.
* Texts are encoded whole, very long ones slice by slice; every id lies in exactly one piece.
* Ties between plans of equal cost go to the earliest cut, so a partition packs alike on each run.
* Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtable.llm.word_tokens import WordTokens
from groundtable.plans.shared import short_batches

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingParams:
    """Sizes and penalties, all in tokens; ``vocabulary`` names a published vocabulary file."""

    width: int = 1024
    end_id: int = 0
    sentence_cut: float = 2.0
    token_cut: float = 12.0
    sequence_cost: float = 4.0
    block_tokens: int = 1 << 18
    vocabulary: str = "byte_bpe_50k.json"


def plan_cuts(positions: np.ndarray, penalties: np.ndarray, params: PackingParams = PackingParams()) -> list[int]:
    """Cut positions, first and last included, of least total cost.

    ``positions`` ascend from 0 to the stream's length with gaps of at most ``width``;
    ``penalties[j]`` is paid for a cut at ``positions[j]``.
    """
    width, sequence, inner = params.width, params.sequence_cost, params.token_cut
    places, pay = positions.tolist(), penalties.tolist()
    size = len(places)
    exact = []
    power = width
    while power >= 64:
        at = np.searchsorted(positions, positions - power)
        hit = (at < size) & (positions[np.minimum(at, size - 1)] == positions - power)
        exact.append((np.where(hit, at, -1).tolist()))
        power //= 2
    cost, parent = [0.0] + [float("inf")] * (size - 1), [0] * size
    one, two = deque([0]), deque()
    waiting = 0  # the next boundary to enter the second queue
    for j in range(1, size):
        x = places[j]
        while places[one[0]] < x - width:
            one.popleft()
        while places[waiting] < x - width:
            key = cost[waiting] + places[waiting]
            while two and cost[two[-1]] + places[two[-1]] >= key:
                two.pop()
            two.append(waiting)
            waiting += 1
        while two and places[two[0]] < x - 2 * width:
            two.popleft()
        i = one[0]
        best, source = cost[i] + places[i] + width - x + sequence, i
        if two:
            i = two[0]
            other = cost[i] + places[i] + 2 * (width + sequence) - x + inner
            if other < best:
                best, source = other, i + size
        for k in exact:
            i = k[j]
            if i >= 0 and cost[i] + sequence < best:
                best, source = cost[i] + sequence, i
        cost[j], parent[j] = best + pay[j], source
        key = cost[j] + x
        while one and cost[one[-1]] + places[one[-1]] >= key:
            one.pop()
        one.append(j)
    cuts, j = [places[-1]], size - 1
    while j > 0:
        i = parent[j]
        if i >= size:
            i -= size
            cuts.append(places[i] + width)
        cuts.append(places[i])
        j = i
    return cuts[::-1]


def _boundaries(tokens: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, params: PackingParams):
    """Cut points of a block and their penalties; no gap exceeds the sequence width."""
    sentence = np.flatnonzero(ends_sentence[tokens]) + 1
    places = np.union1d(np.concatenate([[0], sentence]), doc_ends)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > params.width)
    inner = [np.arange(places[i] + params.width, places[i + 1], params.width) for i in wide]
    forced = np.concatenate(inner) if inner else np.zeros(0, dtype=np.int64)
    every = np.union1d(places, forced)
    penalties = np.full(len(every), params.sentence_cut)
    penalties[np.isin(every, forced)] = params.token_cut
    penalties[np.isin(every, doc_ends)] = 0.0
    return every, penalties


def _pack_block(ids: list, docs: list[np.ndarray], ends_sentence: np.ndarray, params: PackingParams, first_sequence: int):
    """(columns of the block's pieces, number of sequences)."""
    tokens = np.concatenate(docs)
    doc_ends = np.cumsum([len(d) for d in docs])
    doc_starts = doc_ends - np.array([len(d) for d in docs])
    cuts = np.array(plan_cuts(*_boundaries(tokens, doc_ends, ends_sentence, params), params))
    starts = np.union1d(cuts[:-1], doc_starts)
    ends = np.append(starts[1:], len(tokens))
    doc = np.searchsorted(doc_ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right") - 1
    raw = memoryview(tokens.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
    columns = [
        pa.array([ids[i] for i in doc], pa.int64()),
        pa.array(starts - doc_starts[doc]),
        pa.array(ends - starts),
        pa.array(crc, pa.int64()),
        pa.array((doc_ends - doc_starts)[doc]),
        pa.array(sequence + first_sequence),
        pa.array(starts - cuts[sequence]),
    ]
    return columns, len(cuts) - 1


_encoders: dict[str, WordTokens] = {}


def _encoder(vocabulary: str) -> WordTokens:
    """One encoder per Python worker, so remembered pre-tokens serve all its tasks."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = WordTokens(public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


def _packer(params: PackingParams):
    names = [field.split()[0] for field in PIECES.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(params.vocabulary)
        ends_sentence = encoder.ends_sentence.copy()
        ends_sentence[params.end_id] = False
        sequences = TaskContext.get().partitionId() << 33
        end = np.array([params.end_id], dtype=np.uint32)
        ids: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, ids, docs, held
            columns, made = _pack_block(ids, docs, ends_sentence, params, sequences)
            sequences, ids, docs, held = sequences + made, [], [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            row_ids, sizes = batch.column("id").to_pylist(), batch.column("n").to_pylist()
            texts, first = batch.column("text"), 0
            while first < batch.num_rows:
                last, size = first, 0
                while last < batch.num_rows and size < 2_000_000:
                    size += sizes[last]
                    last += 1
                for row, found in zip(row_ids[first:last], encoder.encode(texts.slice(first, last - first).to_pylist())):
                    ids.append(row)
                    docs.append(np.concatenate([found, end]))
                    held += len(docs[-1])
                    if held >= params.block_tokens:
                        yield flush()
                first = last
        if docs:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PackingParams = PackingParams()
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.length(text).alias("n"))
    return rows.mapInArrow(_packer(params), PIECES).withColumnRenamed("id", id_col)
