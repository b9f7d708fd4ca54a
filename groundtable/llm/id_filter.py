"""A bitmap over hashed ids, to leave out rows before a shuffle.

Ids that were marked always pass; others pass at the bitmap's fill rate.  The join that follows is
exact, so the filter saves traffic and never decides.  The bitmap has about sixteen bits an id up to
a bound; with very many more ids than that it lets most rows pass and the join alone does the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtable.llm.byte_hash import mix


def _slots(ids: pa.Array, bits: int) -> np.ndarray:
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def mark_ids(ids: DataFrame, most_bits: int = 26) -> np.ndarray:
    """The bitmap of the column ``id`` of a stored table, at most ``2**most_bits`` bits.

    It is put together as 64-bit words on the executors, so at most ``2**most_bits / 64`` rows reach the driver.
    """
    bits = min(most_bits, max(12, (16 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(batch.column("id"), bits))
            ones = np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(ones)], ["word", "ones"])

    words = ids.select("id").mapInArrow(mark, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["ones"].to_numpy()
    return bitmap


def passes(ids: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """For each id whether it may have been marked."""
    slots = _slots(ids, int(bitmap.size * 64 - 1).bit_length())
    return ((bitmap[slots >> 6].view(np.uint64) >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def marked(ids: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Row numbers whose id may have been marked."""
    return np.flatnonzero(passes(ids, bitmap))
