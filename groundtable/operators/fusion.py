"""Fusion of ranked lists, the relevance gate, and what follows up to the answer's context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtable.functions.text import url_version


@dataclass(frozen=True)
class GateParams:
    """Fixed values of the fusion and of the relevance gate."""

    rrf_k: int = 20
    min_cosine: float = 0.60
    floor_cosine: float = 0.46
    min_bm25: float = 8.0
    min_overlap: int = 1
    min_coverage: float = 0.5
    sure_cosine: float = 0.78
    sure_overlap: int = 5
    sure_coverage: float = 0.9


DEFAULTS = GateParams()


def legs(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both ranked lists in long form: (question_id, leg, rank, chunk_id, score)."""
    one = lambda df, name, place: df.select("question_id", F.lit(name).alias("leg"), F.lit(place).alias("leg_place"), "rank", "chunk_id", "score")
    return one(keyword, "keyword", 0).unionByName(one(semantic, "semantic", 1))


def fuse_ranks(ranked: DataFrame, params: GateParams = DEFAULTS, weights: dict[str, float] | None = None) -> DataFrame:
    """F1, F2: one row per question and chunk with its reciprocal-rank score, ranks by leg and fused place."""
    weight = F.lit(1.0)
    for leg, w in (weights or {}).items():
        weight = F.when(F.col("leg") == leg, F.lit(w)).otherwise(weight)
    by_leg = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    merged = ranked.groupBy("question_id", "chunk_id").agg(
        F.sum(weight / (params.rrf_k + F.col("rank"))).alias("rrf"),
        by_leg("keyword", "score").alias("bm25"),
        by_leg("semantic", "score").alias("cosine"),
        by_leg("keyword", "rank").alias("keyword_rank"),
        by_leg("semantic", "rank").alias("semantic_rank"),
        F.min(F.struct("leg_place", "rank")).alias("seen"),
    )
    order = Window.partitionBy("question_id").orderBy(
        F.desc(F.round("rrf", 9)), F.desc(F.round(F.coalesce("cosine", F.lit(0.0)), 9)), "seen", "chunk_id"
    )
    return merged.withColumn("place", F.row_number().over(order)).drop("seen")


def anchored(fused: DataFrame, k: int = 6) -> DataFrame:
    """each leg's first chunk gets a seat just below the winner; the list is then cut to k."""
    spot = (
        F.when(F.col("place") <= k, F.when(F.col("place") == 1, 0.0).otherwise(F.col("place").cast("double")))
        .when(F.col("semantic_rank") == 1, 0.5)
        .when(F.col("keyword_rank") == 1, 0.75)
    )
    seated = fused.withColumn("spot", spot).where("spot IS NOT NULL").withColumn("anchored", F.col("place") > k)
    order = Window.partitionBy("question_id").orderBy("spot")
    return seated.withColumn("final", F.row_number().over(order)).where(F.col("final") <= k).drop("spot")


def signals(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """best scores and agreement of the two lists' first ten; no question is lost without hits."""
    best = ranked.groupBy("question_id").agg(
        F.max(F.when(F.col("leg") == "semantic", F.col("score"))).alias("best_cosine"),
        F.max(F.when(F.col("leg") == "keyword", F.col("score"))).alias("best_bm25"),
        F.sum(F.when(F.col("leg") == "keyword", 1).otherwise(0)).alias("keyword_hits"),
        F.sum(F.when(F.col("leg") == "semantic", 1).otherwise(0)).alias("semantic_hits"),
    )
    tops = ranked.where("rank <= 10").groupBy("question_id", "chunk_id").agg(F.count_distinct("leg").alias("lists")).where("lists = 2")
    overlap = tops.groupBy("question_id").agg(F.count("*").alias("overlap"))
    joined = questions.select("question_id").join(best, "question_id", "left").join(overlap, "question_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("overlap", "keyword_hits", "semantic_hits")})


def leg_failures(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """whether a leg gave a question nothing; such a leg is an empty list, and the question stays."""
    n = lambda leg: F.count(F.when(F.col("leg") == leg, 1)) == 0
    joined = questions.select("question_id").join(ranked.select("question_id", "leg"), "question_id", "left")
    return joined.groupBy("question_id").agg(n("keyword").alias("keyword_missing"), n("semantic").alias("semantic_missing"), F.count("leg").alias("hits"))


def gate(signal: DataFrame, params: GateParams = DEFAULTS) -> DataFrame:
    """whether a question may be answered from the corpus, and why."""
    cos, bm25 = F.coalesce("best_cosine", F.lit(0.0)), F.coalesce("best_bm25", F.lit(0.0))
    semantic = cos >= params.min_cosine
    together = (
        (cos >= params.floor_cosine) & (bm25 >= params.min_bm25)
        & (F.coalesce("overlap", F.lit(0)) >= params.min_overlap) & (F.coalesce("coverage", F.lit(0.0)) >= params.min_coverage)
    )
    reason = F.when(semantic, "semantic").when(together, "corroborated").otherwise("below-threshold")
    return signal.withColumn("pass", semantic | together).withColumn("reason", reason)


def multi_query(ranked: DataFrame, k: int = 6, params: GateParams = DEFAULTS) -> DataFrame:
    """the lists of all of a question's phrasings in one fusion, cut to a shortlist of max(2k, 12).

    ``ranked`` is the long form of :func:`legs` with the column parent_id.  Every phrasing adds two lists; a
    chunk's score is the sum over all lists that hold it, so one that several phrasings find rises.  ``ranks``
    maps lists (``keyword:7``) to its rank there; bm25 and cosine are the best of their kind.  Ties go by
    cosine, then by the first list that holds the chunk.
    """
    name = F.concat_ws(":", "leg", F.col("question_id").cast("string"))
    best = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("score")))
    merged = ranked.groupBy("parent_id", "chunk_id").agg(
        F.sum(1.0 / (params.rrf_k + F.col("rank"))).alias("rrf"),
        best("keyword").alias("bm25"),
        best("semantic").alias("cosine"),
        F.map_from_entries(F.collect_list(F.struct(name, "rank"))).alias("ranks"),
        F.min(F.struct("question_id", "leg_place", "rank")).alias("seen"),
    )
    order = Window.partitionBy("parent_id").orderBy(F.desc(F.round("rrf", 9)), F.desc(F.round(F.coalesce("cosine", F.lit(0.0)), 9)), "seen", "chunk_id")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(2 * k, 12)).drop("seen")


def multi_query_stats(phrasings: DataFrame, ranked: DataFrame) -> DataFrame:
    """per question the number of its phrasings (parent_id, question_id), hits by kind and best scores; none is lost."""
    kind = lambda leg: F.when(F.col("leg") == leg, F.col("score"))
    found = ranked.groupBy("parent_id").agg(
        F.count(F.when(F.col("leg") == "keyword", 1)).alias("keyword_hits"),
        F.count(F.when(F.col("leg") == "semantic", 1)).alias("semantic_hits"),
        F.max(kind("keyword")).alias("best_bm25"),
        F.max(kind("semantic")).alias("best_cosine"),
    )
    joined = phrasings.groupBy("parent_id").agg(F.count_distinct("question_id").alias("queries")).join(found, "parent_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("keyword_hits", "semantic_hits")})


def hydrate(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked ids joined with their chunks last; ids without a chunk drop out."""
    return results.join(chunks, "chunk_id")


def page_chunks(requests: DataFrame, chunks: DataFrame, limit: int = 12) -> DataFrame:
    """F8: the chunks of the page at a URL, whatever its anchor, in reading order.

    Chunks are ranked within their page once and cut before any request is joined, so a page that is asked for
    often is not multiplied beyond ``limit``.
    """
    base = lambda c: F.substring_index(c, "#", 1)
    asked = requests.withColumn("page", base(F.col("url")))
    order = Window.partitionBy("page").orderBy("ordinal", "chunk_id")
    first = chunks.withColumn("page", base(F.col("source_url"))).join(asked.select("page").distinct(), "page", "left_semi")
    return asked.join(first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit), "page")


def pin_page(pinned: DataFrame, results: DataFrame, k: int = 6) -> DataFrame:
    """pinned chunks first, then the fused ones that are not among them; k plus the pinned ones at most."""
    rest = results.join(pinned.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    both = pinned.select("question_id", "chunk_id", F.lit(0).alias("part"), "place").unionByName(
        rest.select("question_id", "chunk_id", F.lit(1).alias("part"), "place")
    )
    counted = both.withColumn("pins", F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).over(Window.partitionBy("question_id")))
    order = Window.partitionBy("question_id").orderBy("part", "place", "chunk_id")
    return counted.withColumn("final", F.row_number().over(order)).where(F.col("final") <= F.col("pins") + k).select("question_id", "chunk_id", "final")


def external_ranking(fused: DataFrame, picks: DataFrame, k: int = 6) -> DataFrame:
    """1-based picks of another ranker come first, repeated and invalid ones ignored, then fused order."""
    first = picks.groupBy("question_id", "pick").agg(F.min("pick_rank").alias("pick_rank"))
    joined = fused.join(first, (fused["question_id"] == first["question_id"]) & (fused["place"] == first["pick"]), "left").select(fused["question_id"], "chunk_id", "place", "pick_rank")
    order = Window.partitionBy("question_id").orderBy(F.col("pick_rank").asc_nulls_last(), "place")
    return joined.withColumn("final", F.row_number().over(order)).where(F.col("final") <= k)


def escalates(passed: Column, question: Column, params: GateParams = DEFAULTS) -> Column:
    """a passed question that is not answered for sure, or compares things, goes to the costly search."""
    sure = (
        (F.coalesce("best_cosine", F.lit(0.0)) >= params.sure_cosine) & (F.col("overlap") >= params.sure_overlap)
        & (F.col("coverage") >= params.sure_coverage)
    )
    compares = question.rlike(r"(?i)\b(vs|versus|compare|compared|difference between)\b") | (F.regexp_count(question, F.lit(r"\?")) >= 2)
    return passed & (~sure | compares)


def search_results(hydrated: DataFrame, registry: DataFrame) -> DataFrame:
    """text only where the source allows excerpts and its mode is full; the version that the source or its URL names."""
    allowed = F.col("can_excerpt") & (F.col("mode") == "full")
    joined = hydrated.join(registry, "source_id", "left")
    version = url_version(F.col("source_url"))
    if "version" in registry.columns:
        version = F.coalesce(F.col("version"), version)
    return joined.withColumn("excerpt", F.when(allowed, F.col("text"))).withColumn("version", version)


def unknown_sources(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests that name a source which is not registered."""
    return requests.where("source_id IS NOT NULL").join(registry.select("source_id"), "source_id", "left_anti")
