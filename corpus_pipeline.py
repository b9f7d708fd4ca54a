"""A training corpus from raw documents: toxicity, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; its result is
written as Parquet and read again as the next one's documents.  All stages but the last return the
columns of ``documents``.  Packing, toxicity and near duplicates have no SQL form.

* Null texts count as empty.  Rows without an id, and rows whose id another row has too, are documents of
  their own: where a stage needs one id a row, such a row goes by a hash of its columns, behind all real ids.
* Of rows that repeat id and text one stays.  An empty table gives an empty result at every stage.
* Columns of the input may have any name beside ``doc_id``, ``text`` and ``source``; none clashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtable.llm.exact_dedup import SPACES, exact_dedup
from groundtable.llm.jaccard_join import jaccard_components
from groundtable.llm.mixing import mix_sources
from groundtable.llm.packing import pack_documents
from groundtable.llm.toxicity import toxicity_score, train_toxicity
from groundtable.plans.shared import spill


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _one_id_a_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with a column of distinct numbers, its name): the id, or a hash where that is null or repeated."""
    key, again = _free_name(docs, "row_key"), _free_name(docs, "id_again")
    repeated = spill(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(again)), "repeated-ids")
    if repeated.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    far = F.lit(1 << 62) + F.xxhash64(*docs.columns).bitwiseAND(F.lit((1 << 62) - 1))
    marked = docs.join(repeated.withColumn(key, F.lit(True)), F.col("doc_id").eqNullSafe(F.col(again)), "left")
    return marked.withColumn(key, F.when(F.col(key), far).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, key), key


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_score(docs, model) < 0.5)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, and one row of it."""
    found = spill(exact_dedup(docs).select("doc_id", "kept", "group_size", F.unhex("text_sha256").alias("digest")), "verdicts")
    digest = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES, " "), 256))

    def same(verdict: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(verdict["doc_id"]) & (digest == verdict["digest"])

    dropped = found.where("NOT kept").select("doc_id", "digest").distinct()
    kept = docs.join(dropped, same(dropped), "left_anti")
    again = spill(found.where("kept AND group_size > 1").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if again.isEmpty():
        return kept
    single = kept.join(again, same(again), "left_anti")
    several = kept.join(again, same(again), "left_semi")
    first = several.groupBy("doc_id", digest).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(first)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word shingle similarity of 0.8 or more the smallest id stays."""
    rows, key = _one_id_a_row(docs)
    dropped = jaccard_components(rows, id_col=key).where(F.col(key) != F.col("component_id")).select(key)
    return rows.join(dropped, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by source weights takes it; documents not taken go."""
    rows, key = _one_id_a_row(docs)
    copies, number = _free_name(rows, "mix_copies"), _free_name(rows, "mix_copy")
    taken = mix_sources(rows, id_col=key).where("copies > 0").groupBy(key).agg(F.max("copies").alias(copies))
    repeated = rows.join(taken, key).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
