"""Sources, pages and documents turned into sections and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Adapter = Callable[[SparkSession, str], DataFrame]


class SourceAdapters:
    """Callables (spark, path) -> DataFrame with doc_path, page_title and text, by the id of their source."""

    def __init__(self) -> None:
        self._known: dict[str, Adapter] = {}

    def add(self, source_id: str) -> Callable[[Adapter], Adapter]:
        """Register a loader; an id is taken once."""

        def register(loader: Adapter) -> Adapter:
            if source_id in self._known:
                raise ValueError(f"source {source_id} has an adapter already")
            self._known[source_id] = loader
            return loader

        return register

    def load(self, spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
        """Chunks (chunk_id, source_id, doc_path, page_title, text, content_hash, char_len) of all sources, or of ``only`` some."""
        whole = None
        for source_id in self._known if only is None else only:
            rows = self._known[source_id](spark, path).where("text IS NOT NULL")
            made = rows.select(
                F.concat(F.lit(f"{source_id}:"), F.substring(F.sha2(F.concat("doc_path", F.lit("#root:1")), 256), 1, 16)).alias("chunk_id"), F.lit(source_id).alias("source_id"),
                "doc_path", "page_title", "text", F.sha2("text", 256).alias("content_hash"), F.length("text").alias("char_len"),
            )
            whole = made if whole is None else whole.unionByName(made)
        if whole is None:
            raise ValueError("no source has an adapter")
        return whole


def source_registry(documents: DataFrame) -> DataFrame:
    """One row per source with licence policy; mode is full if excerpts are allowed, else summarize or link."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    can_excerpt, summarize = number % 3 == 0, number % 3 == 1
    return documents.where("source IS NOT NULL").select("source").distinct().select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("Source "), number.cast("string")).alias("source_name"),
        can_excerpt.alias("can_excerpt"),
        F.when(can_excerpt, "full").when(summarize, "summarize").otherwise("link").alias("mode"),
        (number % 5).alias("priority"),
    )


REGISTRY_SQL = r"""registry AS (
  SELECT source AS source_id, 'Source ' || n AS source_name, n % 3 = 0 AS can_excerpt,
         CASE n % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'summarize' ELSE 'link' END AS mode, n % 5 AS priority
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS n FROM documents WHERE source IS NOT NULL)
)"""


def first_words(text, n: int):
    return F.array_join(F.slice(F.split(text, r"[ \n]+", n + 1), 1, n), " ")


def chunks(documents: DataFrame) -> DataFrame:
    """One chunk per document with id, content hash and titles."""
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    return documents.where("text IS NOT NULL AND source IS NOT NULL").select(
        F.concat_ws(":", "source", F.substring(F.sha2(F.concat(path, F.lit("#root:1")), 256), 1, 16)).alias("chunk_id"),
        F.col("source").alias("source_id"),
        "doc_id",
        first_words("text", 6).alias("page_title"),
        first_words("text", 5).alias("section_title"),
        "text",
        F.concat(F.lit("https://docs.example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.sha2("text", 256).alias("content_hash"),
        F.length("text").alias("char_len"),
        F.col("doc_id").alias("ordinal"),
    )


CHUNKS_SQL = r"""chunks AS (
  SELECT source || ':' || substr(sha256('docs/' || doc_id || '#root:1'), 1, 16) AS chunk_id, source AS source_id, doc_id,
         array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 6), ' ') AS page_title,
         array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 5), ' ') AS section_title,
         text, 'https://docs.example.org/' || source || '/' || doc_id AS source_url, sha256(text) AS content_hash,
         length(text) AS char_len, doc_id AS ordinal
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
)"""


def sections(documents: DataFrame) -> DataFrame:
    """S3: one row per line of a document, as a section with place, level, title and body."""
    lines = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "body"))
    return lines.select(
        "doc_id", "ord", (F.col("ord") % 4 + 1).alias("level"), F.array_join(F.slice(F.split("body", " "), 1, 5), " ").alias("title"), "body"
    )


SECTIONS_SQL = r"""sections AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CAST((i - 1) % 4 + 1 AS INTEGER) AS level,
         array_to_string(list_slice(string_split(lines[i], ' '), 1, 5), ' ') AS title, lines[i] AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) t(i)
)"""
