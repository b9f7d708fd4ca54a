"""Near-duplicate vectors by spherical-cap filters from random product codes.

A filter is a pair of codewords, one for each half of the (rotated) coordinates; a vector lies in the
filter's cap when its inner product with the pair exceeds a threshold.  List decoding finds all such
pairs from the two halves' inner products without visiting the others.  Vectors meet in the tiles of
the filters that they share, and every meeting is verified by cosine in double precision.  The cap's
size follows the number of vectors per label, so that tiles stay small as data grow; the number of
filters follows from the wanted recall.

* Only vectors of equal, non-null label and equal length link.  Null and zero vectors, and those with
  null or non-finite components, link with nothing and are their own component.
* Equal vectors of a label form a class that is compared once and counted by its size (ties).
* A tile of more than ``tile_rows`` vectors is cut into chunks, and each pair of chunks is a task of
  its own.  A tile returns counts and one tree of links per component, never its pairs.  A pair that
  shares several filters is counted in the first of them only.
* What travels to a tile is the vector as given (four bytes a component for single precision) and its
  filters as four-byte numbers; unit vectors are made in the tile, in double precision.
* Repeated rows count as vectors of their own.  Rows that repeat an id with other vectors are counted
  together under that id.  An empty table gives an empty result.
* Input columns beside id, vector and label are ignored, also those named like an output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundtable.llm.components import connected_components
from groundtable.plans.shared import shuffle_width, spill

_PARTITION = 64 << 20  # bytes of tiles that one task should get


@dataclass(frozen=True)
class CapParams:
    """``miss`` is the modelled share of links at the least cosine that share no filter.

    Filters of one code share codewords, so a vector's filters come in clumps; ``codes`` independent
    codes, each with a rotation of its own, even that out.
    """

    cosine: float = 0.93
    miss: float = 0.0005
    codes: int = 48
    rows_per_cap: int = 32
    tile_rows: int = 1024
    seed: int = 11


@dataclass(frozen=True)
class CapCode:
    """Codewords per half, and the cap's threshold in standard deviations."""

    words: int
    threshold: float


def plan_code(n: int, params: CapParams) -> CapCode:
    """The code for ``n`` vectors per label: smaller caps and more filters as n grows.

    Filters are numbered with 31 bits, enough for some 10**10 vectors a label.
    """
    inside = min(0.05, max(1e-9, params.rows_per_cap / max(n, 1)))
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(middle / math.sqrt(2)) > inside else (low, middle)
    x = np.linspace(low, low + 8, 4001)
    spread = math.sqrt(1 - params.cosine**2)
    tail = np.array([0.5 * math.erfc((low - params.cosine * v) / spread / math.sqrt(2)) for v in x])
    both = np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tail, x) / inside
    wanted = math.log(1 / params.miss) / both
    return CapCode(math.ceil(math.sqrt(wanted / inside / params.codes)), low)


def _codebook(dim: int, words: int, codes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The Gaussian codewords of both halves of each code, rotated back to the vectors' axes."""
    random = np.random.RandomState(seed)
    half = (dim + 1) // 2
    out = []
    for _ in range(codes):
        rotation = np.linalg.qr(random.randn(dim, dim))[0]
        out.append((rotation[:, :half] @ random.randn(half, words), rotation[:, half:] @ random.randn(dim - half, words)))
    return out


def _decode(first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) with first[row, i] + second[row, j] >= threshold, the filter being i * words + j.

    Only the words i that some j can lift over the threshold are visited.
    """
    rows, i = np.nonzero(first >= threshold - second.max(axis=1, keepdims=True))
    at, j = np.nonzero(second[rows] >= (threshold - first[rows, i])[:, None])
    return rows[at], i[at] * first.shape[1] + j


def _unit(vector: np.ndarray) -> np.ndarray:
    v = vector.astype(np.float64)
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


def _filters(code: CapCode, params: CapParams):
    """Adds to each vector its bytes and the filters whose caps hold it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list] = {}
        for batch in batches:
            given = [vector.values.to_numpy(zero_copy_only=False) for vector in batch.column("vector")]
            sizes = np.array([len(v) for v in given])
            rows, filters = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                if dim not in books:
                    books[dim] = _codebook(dim, code.words, params.codes, params.seed)
                for part in np.array_split(own, -(-len(own) // 1024)):
                    unit = np.stack([_unit(given[i]) for i in part])
                    for k, (a, b) in enumerate(books[dim]):
                        row, found = _decode(unit @ a, unit @ b, code.threshold)
                        rows.append(part[row])
                        filters.append(found + k * code.words**2)
            row, flat = np.concatenate(rows), np.concatenate(filters)
            order = np.lexsort((flat, row))
            offsets = np.searchsorted(row[order], np.arange(len(given) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[order].astype(np.int32)))  # below 2**31: see plan_code
            raw = [v.tobytes() for v in given]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "label", "space", "copies")] + [pa.array(raw, pa.binary()), lists],
                ["id", "label", "space", "copies", "raw", "filters"],
            )

    return decode


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric link matrix."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(cosine: float, kind: type):
    """Count the links of each tile; the input is sorted by tile.  ``kind`` is the vectors' precision."""
    keys = ["space", "filter", "i", "j"]

    def tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """A tile is found by a hash of label and length, so these are compared themselves here."""
        labels = pc.dictionary_encode(table.column("label").combine_chunks()).indices.to_numpy()
        alike = np.stack([labels, pc.binary_length(table.column("raw").combine_chunks()).to_numpy()], axis=1)
        for group in [None] if (alike == alike[0]).all() else np.unique(alike, axis=0):
            part = table if group is None else table.take(pa.array(np.flatnonzero((alike == group).all(axis=1))))
            if part.num_rows > 1 and (found := links(part)) is not None:
                yield found

    def links(table: pa.Table) -> pa.RecordBatch | None:
        filter_id, i, j = (table.column(c)[0].as_py() for c in ("filter", "i", "j"))
        unit = np.stack([_unit(np.frombuffer(raw, dtype=kind)) for raw in table.column("raw").to_pylist()])
        linked = unit @ unit.T >= cosine
        chunk = table.column("chunk").to_numpy()
        if i != j:
            linked &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        lists = table.column("filters").combine_chunks()
        flat = lists.flatten().to_numpy()
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        earlier = flat < filter_id
        if earlier.any():
            seen, column = np.unique(flat[earlier], return_inverse=True)
            member = np.zeros((len(lists), len(seen)), dtype=np.float32)
            member[rows[earlier], column] = 1
            linked &= member @ member.T == 0
        root = _roots(linked)
        ids = table.column("id").to_numpy()
        counts = linked @ table.column("copies").to_numpy()
        some = np.flatnonzero(linked.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(counts[some].astype(np.int64)), pa.array(ids[root[some]])], ["id", "links", "root"]
        )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)]):
                key = tuple(marks[start])
                if key != last and held:
                    yield from tile(pa.concat_tables(held))
                    held = []
                held.append(table.slice(start, end - start))
                last = key
        if held:
            yield from tile(pa.concat_tables(held))

    return verify


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    params: CapParams = CapParams(),
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (the component's smallest id)."""
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.elementType == T.FloatType()
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    usable = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0) & F.col(label_col).isNotNull()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    good = rows.where("usable")
    space = F.xxhash64("label", F.size("vector"))
    classes = spill(
        good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("space", space),
        "vectors",
    )
    largest = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    code = plan_code(largest, params)
    decoded = classes.select("id", "label", "space", "copies", "vector").mapInArrow(
        _filters(code, params), "id long, label string, space long, copies long, raw binary, filters array<int>"
    )
    placed = spill(decoded, "caps")
    weight = F.size("filters") * (F.octet_length("raw") + 4 * F.size("filters") + 64)
    width = max(shuffle_width(spark), -(-(placed.agg(F.sum(weight)).first()[0] or 0) // _PARTITION))
    members = placed.select("*", F.explode("filters").alias("filter"))
    large = (
        members.groupBy("space", "filter").agg(F.count("*").alias("n")).where(F.col("n") > params.tile_rows)
        .select("space", "filter", F.ceil(F.col("n") / (params.tile_rows // 2)).cast("int").alias("chunks"))
    )
    chunks = F.coalesce("chunks", F.lit(1))
    tiles = (
        members.join(large, ["space", "filter"], "left")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .select("space", "filter", "i", "j", "chunk", "id", "label", "copies", "raw", "filters")
        .repartition(int(width), "space", "filter", "i", "j")
        .sortWithinPartitions("space", "filter", "i", "j")
    )
    found = spill(tiles.mapInArrow(_verify(params.cosine, np.float32 if single else np.float64), "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.join(counts, "id", "left")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    linked = good.join(known, ["label", "vector"], "left").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
