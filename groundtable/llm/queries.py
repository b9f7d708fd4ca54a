"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtable.llm.embedding_dedup import near_vectors
from groundtable.llm.exact_dedup import exact_dedup
from groundtable.llm.fill_middle import fill_middle, restore_text
from groundtable.llm.html_extract import extract_pages
from groundtable.llm.importance import importance_sample
from groundtable.llm.jaccard_join import JaccardParams, jaccard_components
from groundtable.llm.language_id import identify_languages
from groundtable.llm.mixing import mix_sources
from groundtable.llm.packing import pack_documents
from groundtable.llm.repeat_removal import remove_repeats
from groundtable.llm.token_files import coded_documents
from groundtable.llm.toxicity import score_toxicity
from groundtable.llm.warc import archive_pages, payload_sha1


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(_read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    found = jaccard_components(_read(spark, sf_dir, "documents"), params=JaccardParams(words=3, num=90, den=100))
    return found.select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words
), sizes AS (
  SELECT doc_id, len(s) AS n_shingles FROM sets
), entries AS (
  SELECT doc_id, unnest(s) AS e FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM entries a JOIN entries b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n_shingles + y.n_shingles - common)
), reach AS (
  SELECT b AS node, a AS root FROM links
  UNION
  SELECT a AS node, b AS root FROM links
  UNION
  SELECT r.node, l.root FROM reach r JOIN (SELECT b AS node, a AS root FROM links UNION ALL SELECT a, b FROM links) l ON r.root = l.node
)
SELECT s.doc_id, CAST(s.n_shingles AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(root), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach ON s.doc_id = node GROUP BY s.doc_id, s.n_shingles
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, after white-space normalisation."""
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels that are not held out."""
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


OP7_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM normal
"""

def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 200-byte repeats cover, and what remains."""
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.93 within a label."""
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    return identify_languages(_read(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights 5, 2, 1."""
    mixed = mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), limits AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals
), weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, source_size * 3 AS cap FROM limits
), levels AS (
  SELECT *, row_number() OVER o AS rank,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, place)
), targets AS (
  SELECT source, source_size,
         coalesce(least(CAST(cap AS DOUBLE), (SELECT arg_min(level, rank) FROM levels WHERE level * weight <= cap) * weight), CAST(cap AS DOUBLE)) AS target
  FROM levels
), expected AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / CAST(t.source_size AS DOUBLE), 3.0) ELSE 0.0 END AS e
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, floor(e) AS certain, e - floor(e) AS p,
         CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank
  FROM expected
), passed AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS lacking,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((certain + CASE WHEN rank IS NOT NULL AND before + size / 2.0 <= lacking THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM passed
"""

def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back; a response's figures come from its payload."""
    records = archive_pages(_read(spark, sf_dir, "pages"))
    response = F.col("record_type") == "response"
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, payload_sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP10_SQL = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), firsts AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM payloads
), parts AS (
  SELECT *, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS fives FROM firsts
), chars AS (
  SELECT *, flatten([[v >> 15, (v >> 10) & 31, (v >> 5) & 31, v & 31] FOR v IN fives]) AS digits FROM parts
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(c AS INTEGER) + 1, 1) FOR c IN digits], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM chars
"""



def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-the-middle form, and rebuilt from it."""
    made = fill_middle(_read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH draws AS (
  SELECT doc_id, coalesce(text, '') AS body, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), cuts AS (
  SELECT doc_id, body, n,
         ('0x' || substr(hex, 1, 8))::BIGINT % (n + 1) AS p, ('0x' || substr(hex, 9, 8))::BIGINT % (n + 1) AS q,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR ('0x' || substr(hex, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(hex, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), pieces AS (
  SELECT *, substr(body, 1, least(p, q)) AS prefix, substr(body, least(p, q) + 1, abs(p - q)) AS middle, substr(body, greatest(p, q) + 1) AS suffix FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN least(p, q) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(p - q) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM pieces
"""


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to coded files in order and read back."""
    found = coded_documents(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the texts of the benchmark."""
    found = importance_sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH crc AS (
  SELECT [list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS step
), texts AS (
  SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), features AS (
  SELECT kind, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), buckets AS (
  SELECT word, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)],
                               lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM features), crc
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t
  FROM features JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN buckets USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w USING (doc_id)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM places) THEN place END AS rank
FROM scores s LEFT JOIN places USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeat_removal": op1_repeat_removal,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_html_extract": op5_html_extract,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_fill_middle": op11_fill_middle,
    "op12_token_files": op12_token_files,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
    "op13_importance": OP13_SQL,
}
