"""Registered queries of text functions, keyword search, vector search, fusion and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtable.functions import text as T
from groundtable.operators import fusion, keyword, vectors
from groundtable.plans.registry import query, table
from groundtable.plans.shared import shuffle_width, spill
from groundtable.sources.corpus import CHUNKS_SQL, REGISTRY_SQL, chunks, source_registry

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(T.STOPWORDS)))
_CACHE_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(T.STOPWORDS) - set(T.NEGATIONS)))


def tokens_sql(column: str) -> str:
    """The DuckDB expression of :func:`groundtable.functions.text.tokenize`."""
    clean = "regexp_replace(w, '^[._-]+|[._-]+$', '', 'g')"
    words = f"list_transform(string_split(regexp_replace(lower({column}), '[^a-z0-9._-]+', ' ', 'g'), ' '), lambda w: {clean})"
    parts = (
        r"CASE WHEN regexp_full_match(c, '[a-z0-9]+(\.[a-z0-9_]+)+') AND length(c) > 6 "
        "THEN list_concat([c], list_filter(string_split(c, '.'), lambda p: length(p) > 2)) ELSE [c] END"
    )
    return f"list_filter(flatten(list_transform({words}, lambda c: {parts})), lambda t: length(t) >= 2 AND length(t) <= 64)"


def distinct_in_order_sql(array: str) -> str:
    return f"list_filter({array}, lambda t, i: list_position({array}, t) = i)"


QUESTIONS_SQL = f"""asked AS (
  SELECT item_id AS question_id, text AS question, {tokens_sql('text')} AS tokens FROM benchmark WHERE text IS NOT NULL
), content AS (
  SELECT question_id, question, tokens, list_filter(tokens, lambda t: t NOT IN ({_STOP})) AS kept FROM asked
), questions AS (
  SELECT question_id, question, tokens, {distinct_in_order_sql('kept')} AS terms FROM content
), wanted AS (
  SELECT question_id, unnest(CASE WHEN len(terms) > 0 THEN list_slice(terms, 1, 12) ELSE list_slice(tokens, 1, 12) END) AS term FROM questions
)"""
POSTINGS_SQL = f"""{CHUNKS_SQL}, fielded AS (
  SELECT chunk_id, source_id, 'page_title' AS field, unnest({tokens_sql('page_title')}) AS term FROM chunks
  UNION ALL SELECT chunk_id, source_id, 'section_title', unnest({tokens_sql('section_title')}) FROM chunks
  UNION ALL SELECT chunk_id, source_id, 'text', unnest({tokens_sql('text')}) FROM chunks
), postings AS (
  SELECT term, chunk_id, source_id, field, count(*) AS tf FROM fielded GROUP BY ALL
), lengths AS (
  SELECT chunk_id, sum(tf) AS len FROM postings GROUP BY chunk_id
), stats AS (
  SELECT count(*) AS n, avg(len) AS avg_len FROM lengths
)"""
BM25_SQL = f"""{QUESTIONS_SQL}, {POSTINGS_SQL}, weighed AS (
  SELECT term, chunk_id, source_id, sum(tf * CASE field WHEN 'page_title' THEN 4.0 WHEN 'section_title' THEN 6.0 ELSE 1.0 END)::DOUBLE AS f
  FROM postings WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), counted AS (
  SELECT term, count(*) AS df FROM weighed GROUP BY term
), scored AS (
  SELECT question_id, chunk_id,
         sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM wanted JOIN weighed USING (term) JOIN counted USING (term) JOIN lengths USING (chunk_id), stats GROUP BY ALL
), keyword AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored
  QUALIFY rank <= 24
)"""
SEMANTIC_SQL = """terms_q AS (
  SELECT question_id, unnest(tokens) AS term FROM questions
), vec_q AS (
  SELECT question_id, term, count(*) AS c FROM terms_q GROUP BY ALL
), vec_c AS (
  SELECT chunk_id, term, sum(tf) AS c FROM postings WHERE field = 'text' GROUP BY ALL
), norm_q AS (
  SELECT question_id, sqrt(sum(c * c)) AS nq FROM vec_q GROUP BY ALL
), norm_c AS (
  SELECT chunk_id, sqrt(sum(c * c)) AS nc FROM vec_c GROUP BY ALL
), dots AS (
  SELECT question_id, chunk_id, sum(q.c * d.c) AS dot FROM vec_q q JOIN vec_c d USING (term) GROUP BY ALL
), semantic AS (
  SELECT question_id, chunk_id, dot / (nq * nc) AS score,
         row_number() OVER (PARTITION BY question_id ORDER BY round(dot / (nq * nc), 9) DESC, chunk_id) AS rank
  FROM dots JOIN norm_q USING (question_id) JOIN norm_c USING (chunk_id) QUALIFY rank <= 24
)"""
FUSED_SQL = f"""{BM25_SQL}, {SEMANTIC_SQL}, ranked AS (
  SELECT question_id, 'keyword' AS leg, 0 AS leg_place, rank, chunk_id, score FROM keyword
  UNION ALL SELECT question_id, 'semantic', 1, rank, chunk_id, score FROM semantic
), merged AS (
  SELECT question_id, chunk_id, sum(1.0::DOUBLE / (20 + rank)) AS rrf, max(score) FILTER (leg = 'keyword') AS bm25, max(score) FILTER (leg = 'semantic') AS cosine,
         max(rank) FILTER (leg = 'keyword') AS keyword_rank, max(rank) FILTER (leg = 'semantic') AS semantic_rank, min(leg_place * 1000 + rank) AS seen
  FROM ranked GROUP BY ALL
), fused AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 9) DESC, round(coalesce(cosine, 0), 9) DESC, seen, chunk_id) AS place FROM merged
), seated AS (
  SELECT *, place > 6 AS anchored, CASE WHEN place = 1 THEN 0 WHEN place <= 6 THEN place WHEN semantic_rank = 1 THEN 0.5 WHEN keyword_rank = 1 THEN 0.75 END AS spot FROM fused
), results AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY spot) AS final FROM seated WHERE spot IS NOT NULL QUALIFY final <= 6
)"""
COVERAGE_SQL = """texts AS (
  SELECT question_id, lower(string_agg(text, chr(10))) AS hay FROM results JOIN chunks USING (chunk_id) GROUP BY question_id
), coverage AS (
  SELECT question_id, CASE WHEN len(terms) = 0 THEN 0 ELSE
    len(list_filter(terms, lambda t: contains(hay, t) OR (length(CASE WHEN length(t) > 6 THEN substr(t, 1, length(t) - 2) ELSE t END) >= 4
      AND contains(hay, CASE WHEN length(t) > 6 THEN substr(t, 1, length(t) - 2) ELSE t END))))::DOUBLE / len(terms) END AS coverage
  FROM questions JOIN texts USING (question_id)
)"""
SIGNALS_SQL = """best AS (
  SELECT question_id, max(score) FILTER (leg = 'semantic') AS best_cosine, max(score) FILTER (leg = 'keyword') AS best_bm25,
    count(*) FILTER (leg = 'keyword') AS keyword_hits, count(*) FILTER (leg = 'semantic') AS semantic_hits FROM ranked GROUP BY question_id
), tops AS (
  SELECT question_id, count(*) AS overlap FROM (SELECT question_id, chunk_id FROM ranked WHERE rank <= 10 GROUP BY ALL HAVING count(DISTINCT leg) = 2) GROUP BY question_id
), signals AS (
  SELECT q.question_id, best_cosine, best_bm25, coalesce(keyword_hits, 0) AS keyword_hits, coalesce(semantic_hits, 0) AS semantic_hits, coalesce(overlap, 0) AS overlap
  FROM questions q LEFT JOIN best USING (question_id) LEFT JOIN tops USING (question_id)
)"""
GATED_SQL = f"""{FUSED_SQL}, {COVERAGE_SQL}, {SIGNALS_SQL}, gated AS (
  SELECT s.*, coalesce(c.coverage, 0) AS coverage, coalesce(best_cosine, 0) >= 0.6 AS sure,
    coalesce(best_cosine, 0) >= 0.46 AND coalesce(best_bm25, 0) >= 8 AND overlap >= 1 AND coalesce(c.coverage, 0) >= 0.5 AS together
  FROM signals s LEFT JOIN coverage c USING (question_id)
)"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def corpus(spark, sf_dir):
    return chunks(table(spark, sf_dir, "documents"))


CHUNKS_A_TASK = 10_000
_stored: dict[tuple[str, str, str], object] = {}


def stored_index(spark, sf_dir):
    """The index with words as a stored table, made once per session and corpus folder; legs and statistics read it.

    Chunks are dealt out by their ids first, some ``CHUNKS_A_TASK`` each, so tasks stay small whatever the files
    of the corpus and do not grow with it.
    """
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), sf_dir)
    if key not in _stored:
        width = max(shuffle_width(spark), -(-table(spark, sf_dir, "documents").count() // CHUNKS_A_TASK))
        dealt = corpus(spark, sf_dir).select("chunk_id", "source_id", *keyword.FIELDS).repartition(width, "chunk_id")
        _stored[key] = spill(keyword.chunk_index(dealt, words=True), "index")
    return _stored[key]


def keyword_leg(spark, sf_dir, index=None):
    index = stored_index(spark, sf_dir) if index is None else index
    return keyword.top_candidates(keyword.bm25(questions(spark, sf_dir), index, best=keyword.DEFAULTS.candidates))


def semantic_leg(spark, sf_dir, index):
    """Cosine of term counts, questions broadcast block by block."""
    asked = T.token_rows(questions(spark, sf_dir), "question", ["question_id"]).groupBy("question_id", "term").agg(F.count("*").alias("qc"))
    return vectors.term_cosine_top(asked, index, keyword.DEFAULTS.candidates)


def ranked(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return spill(fusion.legs(keyword_leg(spark, sf_dir, index), semantic_leg(spark, sf_dir, index)), "ranked")


def results(spark, sf_dir, k: int = 6, listed=None):
    return fusion.anchored(fusion.fuse_ranks(ranked(spark, sf_dir) if listed is None else listed), k)


def gated(spark, sf_dir, listed=None):
    listed = ranked(spark, sf_dir) if listed is None else listed
    found = fusion.anchored(fusion.fuse_ranks(listed))
    hay = fusion.hydrate(found.select("question_id", "chunk_id"), corpus(spark, sf_dir)).groupBy("question_id").agg(
        F.array_join(F.collect_list("text"), "\n").alias("hay")  # k chunks per question
    )
    asked = questions(spark, sf_dir)
    coverage = asked.join(hay, "question_id").select(
        "question_id", T.term_coverage(T.content_terms(F.col("question")), F.col("hay")).alias("coverage")
    )
    signal = fusion.signals(asked, listed).join(coverage, "question_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return fusion.gate(signal)


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# text functions over the questions


@query("X1_tokenize", f"WITH {QUESTIONS_SQL} SELECT question_id, array_to_string(tokens, ' ') AS tokens FROM questions")
def x1(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", F.array_join(T.tokenize(F.col("question")), " ").alias("tokens"))


@query("X2_content_terms", f"WITH {QUESTIONS_SQL} SELECT question_id, array_to_string(terms, ' ') AS terms FROM questions")
def x2(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", F.array_join(T.content_terms(F.col("question")), " ").alias("terms"))


@query("X3_cache_terms", f"WITH {QUESTIONS_SQL}, c AS (SELECT question_id, list_filter(tokens, lambda t: t NOT IN ({_CACHE_STOP})) AS kept FROM questions) "
       f"SELECT question_id, array_to_string({distinct_in_order_sql('kept')}, ' ') AS terms FROM c")
def x3(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", F.array_join(T.cache_terms(F.col("question")), " ").alias("terms"))


@query("X4_search_terms", f"WITH {QUESTIONS_SQL} SELECT question_id, term FROM wanted")
def x4(spark, sf_dir):
    return keyword.query_terms(questions(spark, sf_dir))


_NORMAL_SQL = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"


@query("X6_normalize_question", f"SELECT conv_id, turn, {_NORMAL_SQL} AS question_key FROM conversations WHERE role = 'user'")
def x6(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", T.normalize_question(F.col("text")).alias("question_key"))


@query("X7_question_slug", r"""WITH b AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base
  FROM conversations WHERE role = 'user'), c AS (SELECT *, regexp_replace(substr(array_to_string(list_slice(string_split(base, '-'), 1, 10), '-'), 1, 70), '-+$', '') AS cut FROM b)
  SELECT conv_id, turn, CASE WHEN cut = '' THEN 'question' ELSE cut END || '-' || substr(sha256(text), 1, 6) AS slug FROM c""")
def x7(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", T.question_slug(F.col("text"), F.sha2("text", 256)).alias("slug"))


@query("X8_cache_key", f"""WITH a AS (SELECT conv_id, turn, text, list_filter({tokens_sql('text')}, lambda t: t NOT IN ({_CACHE_STOP})) AS kept FROM conversations WHERE role = 'user'),
  k AS (SELECT *, array_to_string({distinct_in_order_sql('kept')}, ' ') AS terms, {_NORMAL_SQL} AS plain FROM a)
  SELECT conv_id, turn, 'epoch-1:' || sha256(CASE WHEN terms <> '' THEN terms ELSE plain END) AS cache_key, 'epoch-1:' || sha256(plain) AS legacy_key FROM k""")
def x8(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", T.cache_key(F.col("text"), F.lit("epoch-1")).alias("cache_key"), T.legacy_key(F.col("text"), F.lit("epoch-1")).alias("legacy_key"))


def _hits_sql(words) -> str:
    pattern = "\\b(" + "|".join(words) + ")"
    return f"len(list_distinct(regexp_extract_all(lower(text), '{pattern}', 1)))"


def _any_sql(patterns) -> str:
    return "regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


@query("X9_topic_class", f"""SELECT doc_id, CASE WHEN {_any_sql(T.META_PATTERNS)} THEN 'meta'
  WHEN {_hits_sql(T.STRONG_WORDS)} >= 1 OR {_hits_sql(T.WEAK_WORDS)} >= 2 OR ({_hits_sql(T.WEAK_WORDS)} >= 1 AND (doc_id % 100) / 100.0 >= 0.25) OR (doc_id % 100) / 100.0 >= 0.62
  THEN 'ftc' ELSE 'off' END AS topic FROM documents WHERE text IS NOT NULL""")
def x9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.topic_class(F.col("text"), (F.col("doc_id") % 100) / F.lit(100.0)).alias("topic"))


@query("X10_intent_class", f"""SELECT doc_id, CASE WHEN {_any_sql([T.RULE_PATTERN])} THEN 'lookup' WHEN {_any_sql(T.DEBUG_PATTERNS)} THEN 'debug'
  WHEN {_any_sql(T.ADVICE_PATTERNS)} THEN 'advice' WHEN {_any_sql(T.LOOKUP_PATTERNS)} THEN 'lookup' ELSE 'advice' END AS intent FROM documents WHERE text IS NOT NULL""")
def x10(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.intent_class(F.col("text")).alias("intent"))


@query("X12_team_number", r"""WITH n AS (SELECT doc_id, regexp_extract(text || ' team #' || doc_id, '(?i)\b(?:team|ftc)\s*#?\s*(\d{1,5})\b', 1) AS d FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN d <> '' AND CAST(d AS INTEGER) BETWEEN 1 AND 99999 THEN CAST(d AS INTEGER) END AS team FROM n""")
def x12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.team_number(F.concat("text", F.lit(" team #"), F.col("doc_id").cast("string"))).alias("team"))


@query("X13_url_version", r"""WITH u AS (SELECT page_id, regexp_extract(url || '/v' || (page_id % 4) || '.1/', '(?i)/(?:v|version/)(\d+(?:\.\d+){0,2})(?:/|$)', 1) AS v FROM pages)
  SELECT page_id, CASE WHEN v <> '' THEN 'v' || v || ' (source URL)' ELSE 'Version not specified by index' END AS version FROM u""")
def x13(spark, sf_dir):
    url = F.concat("url", F.lit("/v"), (F.col("page_id") % 4).cast("string"), F.lit(".1/"))
    return table(spark, sf_dir, "pages").select("page_id", T.url_version(url).alias("version"))


@query("X14_retrieval_query", r"""SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(trim(text), '[ \n\t\r\f]+'), lambda w: w <> '')) <= 8
  THEN source || ' — ' || lang || ' — ' || text ELSE text END AS q FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL""")
def x14(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    return docs.select("doc_id", T.retrieval_query(F.col("text"), F.col("source"), F.col("lang")).alias("q"))


# keyword index


_PLACED_SQL = r"""{chunks}, runs AS (
  SELECT chunk_id, 'page_title' AS field, regexp_extract_all(lower(page_title), '[a-z0-9._-]+') AS r FROM chunks
  UNION ALL SELECT chunk_id, 'section_title', regexp_extract_all(lower(section_title), '[a-z0-9._-]+') FROM chunks
  UNION ALL SELECT chunk_id, 'text', regexp_extract_all(lower(text), '[a-z0-9._-]+') FROM chunks
), raw AS (
  SELECT chunk_id, field, i - 1 AS place, regexp_replace(r[i], '^[._-]+|[._-]+$', '', 'g') AS t FROM runs, unnest(range(1, len(r) + 1)) u(i)
), placed AS (
  SELECT chunk_id, field, place, unnest(CASE WHEN regexp_full_match(t, '[a-z0-9]+(\.[a-z0-9_]+)+') AND length(t) > 6
    THEN list_concat([t], list_filter(string_split(t, '.'), lambda p: length(p) > 2)) ELSE [t] END) AS term FROM raw
)""".replace("{chunks}", CHUNKS_SQL)


@query("K1_postings", f"""WITH {_PLACED_SQL} SELECT term, chunk_id, field, count(*) AS tf, array_to_string(list_sort(list(place)), ' ') AS positions
  FROM placed WHERE length(term) BETWEEN 2 AND 64 GROUP BY ALL""")
def k1(spark, sf_dir):
    made = keyword.postings(corpus(spark, sf_dir), positions=True)
    return made.where("tf > 0").select("term", "chunk_id", "field", "tf", F.array_join("positions", " ").alias("positions"))


@query("K2_vocabulary")
def k2(spark, sf_dir):
    return keyword.vocabulary(keyword.entries(stored_index(spark, sf_dir), "tf").where("tf > 0"))


@query("K2_stemmed_postings")
def k2_postings(spark, sf_dir):
    return keyword.stemmed_postings(stored_index(spark, sf_dir)).select("term", "chunk_id", "field", "tf")


_PHRASE_SEARCH_SQL = BM25_SQL.replace("text AS question", "regexp_replace(text, '^([a-zA-Z0-9_]+)[^a-zA-Z0-9_]+([a-zA-Z0-9_]+)', '\\1-\\2') AS question").replace(
    tokens_sql("text") + " AS tokens", tokens_sql("regexp_replace(text, '^([a-zA-Z0-9_]+)[^a-zA-Z0-9_]+([a-zA-Z0-9_]+)', '\\1-\\2')") + " AS tokens", 1
).replace("  FROM postings WHERE term IN (SELECT term FROM wanted) GROUP BY ALL", """  FROM (SELECT * FROM postings WHERE term IN (SELECT term FROM wanted) AND NOT regexp_matches(term, '[._-]') UNION ALL SELECT * FROM found) GROUP BY ALL""").replace(
    "), weighed AS (", """), phrases AS (
  SELECT DISTINCT term, list_filter(regexp_split_to_array(term, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM wanted WHERE regexp_matches(term, '[._-]')
), bodies AS (
  SELECT chunk_id, source_id, field, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: w <> '') AS w
  FROM (SELECT chunk_id, source_id, 'page_title' AS field, page_title AS body FROM chunks UNION ALL SELECT chunk_id, source_id, 'section_title', section_title FROM chunks UNION ALL SELECT chunk_id, source_id, 'text', text FROM chunks)
), places AS (
  SELECT chunk_id, source_id, field, i, w[i] AS word FROM bodies, unnest(range(1, len(w) + 1)) t(i) WHERE w[i] IN (SELECT unnest(w) FROM phrases)
), met AS (
  SELECT term, len(p.w) AS need, chunk_id, source_id, field, i - j AS start, count(DISTINCT j) AS n FROM (SELECT term, w, unnest(range(1, len(w) + 1)) AS j FROM phrases) p JOIN places ON word = p.w[j] GROUP BY ALL
), found AS (
  SELECT term, chunk_id, source_id, field, count(*) AS tf FROM met WHERE n = need GROUP BY ALL
), weighed AS (""", 1)


@query("K5_phrase_search", f"WITH {_PHRASE_SEARCH_SQL} SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM keyword")
def k5_search(spark, sf_dir):
    """Questions whose first two words are one hyphenated term, which the index takes as adjacent words."""
    text = F.regexp_replace("question", r"^(\w+)\W+(\w+)", "$1-$2")
    asked = questions(spark, sf_dir).withColumn("question", text)
    return _round(keyword.top_candidates(keyword.bm25(asked, stored_index(spark, sf_dir), best=keyword.DEFAULTS.candidates)), "score")


@query("K8_snippets", f"WITH {CHUNKS_SQL} SELECT chunk_id, sha256(text) AS snippet_hash FROM chunks")
def k8(spark, sf_dir):
    """What follows the header paragraph of a rendered chunk is its text again."""
    rendered = corpus(spark, sf_dir).select("chunk_id", F.concat(F.lit("# "), F.replace("page_title", F.lit("\n"), F.lit(" ")), F.lit("\n\n"), "text").alias("text"))
    return rendered.select("chunk_id", F.sha2(keyword.snippet(F.col("text")), 256).alias("snippet_hash"))


@query("K3_corpus_stats", f"WITH {POSTINGS_SQL} SELECT n, round(avg_len, 6) AS avg_len FROM stats")
def k3(spark, sf_dir):
    return _round(keyword.corpus_stats(keyword.postings(corpus(spark, sf_dir))), "avg_len")


@query("K3_document_frequency", f"WITH {POSTINGS_SQL} SELECT term, count(DISTINCT chunk_id) AS df FROM postings GROUP BY term")
def k3_df(spark, sf_dir):
    return keyword.document_frequency(corpus(spark, sf_dir))


@query("K4_bm25", f"WITH {BM25_SQL} SELECT question_id, chunk_id, round(score, 6) AS score FROM scored")
def k4(spark, sf_dir):
    return _round(keyword.bm25(questions(spark, sf_dir), stored_index(spark, sf_dir)), "score")


@query("K5_phrases", r"""WITH phrases AS (SELECT DISTINCT array_to_string(list_slice(w, 1, 2), '-') AS phrase, list_slice(w, 1, 2) AS words FROM (
    SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 2),
  places AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
  pairs AS (SELECT doc_id, w[i] || '-' || w[i + 1] AS phrase FROM places, unnest(range(1, len(w))) t(i))
  SELECT doc_id, phrase, count(*) AS tf FROM pairs WHERE phrase IN (SELECT phrase FROM phrases) GROUP BY ALL""")
def k5(spark, sf_dir):
    words = F.filter(F.split(F.lower("question"), "[^a-z0-9]+"), lambda w: w != "")
    phrases = questions(spark, sf_dir).where(F.size(words) >= 2).select(F.array_join(F.slice(words, 1, 2), "-").alias("phrase")).distinct()
    found = keyword.posted_phrases(stored_index(spark, sf_dir), phrases).where("field = 'text'")
    return found.join(corpus(spark, sf_dir).select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "phrase", "tf")


@query("K6_source_filter", f"WITH {BM25_SQL} SELECT question_id, chunk_id, round(score, 6) AS score FROM scored JOIN chunks USING (chunk_id) WHERE source_id = 'src' || (question_id % 20)")
def k6(spark, sf_dir):
    asked = questions(spark, sf_dir)
    sources = asked.select("question_id", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")).alias("source_id"))
    return _round(keyword.bm25(asked, stored_index(spark, sf_dir), sources=sources), "score")


@query("K7_top_candidates", f"WITH {BM25_SQL} SELECT question_id, chunk_id, rank, round(score, 6) AS score FROM keyword")
def k7(spark, sf_dir):
    return _round(keyword_leg(spark, sf_dir), "score")


_CHANGED_SQL = """SELECT chunk_id, CASE WHEN doc_id % 10 = 5 THEN text || ' amended' ELSE text END AS text, CASE WHEN doc_id % 10 = 5 THEN page_title || ' v2.beta' ELSE page_title END AS page_title,
  section_title FROM chunks WHERE doc_id % 10 <> 7"""


@query("K9_refresh_postings", f"""WITH {CHUNKS_SQL}, after AS ({_CHANGED_SQL}), t AS (SELECT chunk_id, 'text' AS field, unnest({tokens_sql('text')}) AS term FROM after
    UNION ALL SELECT chunk_id, 'page_title', unnest({tokens_sql('page_title')}) FROM after UNION ALL SELECT chunk_id, 'section_title', unnest({tokens_sql('section_title')}) FROM after),
  l AS (SELECT chunk_id, count(*) AS len FROM t GROUP BY chunk_id)
  SELECT chunk_id, field, term, count(*) AS tf, len FROM t JOIN l USING (chunk_id) GROUP BY ALL""")
def k9(spark, sf_dir):
    """Of ten chunks one changes in text and title and one goes; all three fields are compared."""
    before = corpus(spark, sf_dir)
    changed = before.where("doc_id % 10 = 5").withColumn("text", F.concat("text", F.lit(" amended"))).withColumn("page_title", F.concat("page_title", F.lit(" v2.beta")))
    made = keyword.refresh_postings(keyword.postings(before), changed, before.where("doc_id % 10 = 7"))
    return made.select("chunk_id", "field", "term", "tf", "len")


# vectors


@query("V4_unit", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)
  SELECT vec_id, i - 1 AS place, round(e[i] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS value FROM v, unnest(range(1, len(e) + 1)) t(i)""")
def v4(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return v.select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("place", "value")).withColumn("value", F.round("value", 6))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").alias("id"), vectors.unit(F.col("embedding")).alias("vector"), "label")


def _top_sql(filtered: bool) -> str:
    unit = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
    same = "AND q.label = v.label" if filtered else ""
    return f"""WITH u AS (SELECT vec_id, label, {unit} AS e FROM embeddings WHERE embedding IS NOT NULL),
  s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(q.e, v.e) AS score FROM u q JOIN u v ON q.vec_id % 100 = 0 {same})
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10"""


@query("V5_cosine_top", _top_sql(False))
def v5(spark, sf_dir):
    all_rows = _vectors(spark, sf_dir)
    return _round(vectors.cosine_top(all_rows.where("id % 100 = 0"), all_rows, 10), "score")


@query("V6_cosine_top_by_label", _top_sql(True))
def v6(spark, sf_dir):
    all_rows = _vectors(spark, sf_dir)
    asked = all_rows.where("id % 100 = 0")
    found = vectors.cosine_top(asked, all_rows, 10, same="label")
    return _round(vectors.same_after_hydration(found, all_rows, asked, "label"), "score").select("query_id", "id", "rank", "score")


# fusion and gate


@query("F1_fused_ranks", f"WITH {FUSED_SQL} SELECT question_id, chunk_id, round(rrf, 6) AS rrf, keyword_rank, semantic_rank, place FROM fused")
def f1(spark, sf_dir):
    return _round(fusion.fuse_ranks(ranked(spark, sf_dir)), "rrf").select("question_id", "chunk_id", "rrf", "keyword_rank", "semantic_rank", "place")


@query("F2_fused_order", f"WITH {FUSED_SQL} SELECT question_id, place, chunk_id, coalesce(round(cosine, 6), 0) AS cosine FROM fused")
def f2(spark, sf_dir):
    made = fusion.fuse_ranks(ranked(spark, sf_dir)).withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return _round(made, "cosine").select("question_id", "place", "chunk_id", "cosine")


@query("F12_leg_failures", f"""WITH {BM25_SQL}, {SEMANTIC_SQL}, legs AS (SELECT question_id, chunk_id, rank, score, 'keyword' AS leg FROM keyword WHERE question_id % 3 <> 0
    UNION ALL SELECT question_id, chunk_id, rank, score, 'semantic' FROM semantic WHERE question_id % 4 <> 0)
  SELECT question_id, count(*) FILTER (leg = 'keyword') = 0 AS keyword_missing, count(*) FILTER (leg = 'semantic') = 0 AS semantic_missing, count(leg) AS hits
  FROM questions LEFT JOIN legs USING (question_id) GROUP BY question_id""")
def f12(spark, sf_dir):
    """The keyword leg fails for every third question, the semantic one for every fourth."""
    left = ranked(spark, sf_dir).where("(leg = 'keyword' AND question_id % 3 <> 0) OR (leg = 'semantic' AND question_id % 4 <> 0)")
    return fusion.leg_failures(questions(spark, sf_dir), left)


@query("F3_anchored", f"WITH {FUSED_SQL} SELECT question_id, chunk_id, anchored, final FROM results")
def f3(spark, sf_dir):
    return results(spark, sf_dir).select("question_id", "chunk_id", "anchored", "final")


@query("F4_signals", f"WITH {FUSED_SQL}, {SIGNALS_SQL} SELECT question_id, round(best_cosine, 6) AS best_cosine, round(best_bm25, 6) AS best_bm25, keyword_hits, semantic_hits, overlap FROM signals")
def f4(spark, sf_dir):
    return _round(fusion.signals(questions(spark, sf_dir), ranked(spark, sf_dir)), "best_cosine", "best_bm25")


@query("F5_gate", f"""WITH {GATED_SQL} SELECT question_id, round(coverage, 6) AS coverage, sure OR together AS pass,
  CASE WHEN sure THEN 'semantic' WHEN together THEN 'corroborated' ELSE 'below-threshold' END AS reason FROM gated""")
def f5(spark, sf_dir):
    return _round(gated(spark, sf_dir), "coverage").select("question_id", "coverage", "pass", "reason")


_PHRASED_SQL = """phrased AS (SELECT *, question_id // 3 AS parent_id FROM ranked)"""


def phrased(spark, sf_dir):
    """Three questions that follow one another are phrasings of one."""
    return ranked(spark, sf_dir).withColumn("parent_id", F.floor(F.col("question_id") / 3))


@query("F6_multi_query", f"""WITH {FUSED_SQL}, {_PHRASED_SQL}, summed AS (SELECT parent_id, chunk_id, sum(1.0::DOUBLE / (20 + rank)) AS rrf, max(score) FILTER (leg = 'keyword') AS bm25,
    max(score) FILTER (leg = 'semantic') AS cosine, count(*) AS lists, min(rank) AS best_rank, min((question_id * 2 + leg_place) * 1000 + rank) AS seen FROM phrased GROUP BY ALL)
  SELECT parent_id, chunk_id, round(rrf, 6) AS rrf, round(bm25, 6) AS bm25, round(cosine, 6) AS cosine, lists, best_rank,
    row_number() OVER (PARTITION BY parent_id ORDER BY round(rrf, 9) DESC, round(coalesce(cosine, 0), 9) DESC, seen, chunk_id) AS place FROM summed QUALIFY place <= 12""")
def f6(spark, sf_dir):
    made = fusion.multi_query(phrased(spark, sf_dir)).withColumns({"lists": F.size("ranks").cast("long"), "best_rank": F.array_min(F.map_values("ranks"))})
    return _round(made.drop("ranks"), "rrf", "bm25", "cosine")


@query("F6_stats", f"""WITH {FUSED_SQL}, {_PHRASED_SQL}, asked_for AS (SELECT question_id // 3 AS parent_id, count(*) AS queries FROM questions GROUP BY ALL)
  SELECT a.parent_id, queries, count(leg) FILTER (leg = 'keyword') AS keyword_hits, count(leg) FILTER (leg = 'semantic') AS semantic_hits,
    round(max(score) FILTER (leg = 'keyword'), 6) AS best_bm25, round(max(score) FILTER (leg = 'semantic'), 6) AS best_cosine
  FROM asked_for a LEFT JOIN phrased USING (parent_id) GROUP BY a.parent_id, queries""")
def f6_stats(spark, sf_dir):
    asked = questions(spark, sf_dir).withColumn("parent_id", F.floor(F.col("question_id") / 3))
    return _round(fusion.multi_query_stats(asked, phrased(spark, sf_dir)), "best_bm25", "best_cosine")


@query("F7_hydrated", f"WITH {FUSED_SQL} SELECT question_id, final, source_id, source_url FROM results JOIN chunks USING (chunk_id)")
def f7(spark, sf_dir):
    return fusion.hydrate(results(spark, sf_dir), corpus(spark, sf_dir)).select("question_id", "final", "source_id", "source_url")


@query("F8_page_chunks", r"""WITH lined AS (SELECT doc_id, i - 1 AS ordinal, 'https://docs.example.org/' || (doc_id % 50) || '#' || doc_id || '-' || (i - 1) AS url
    FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), unnest(range(1, n + 1)) t(i)),
  asked AS (SELECT item_id AS request_id, 'https://docs.example.org/' || (item_id % 50) AS page FROM benchmark)
  SELECT request_id, url, row_number() OVER (PARTITION BY request_id ORDER BY ordinal, url) AS place FROM asked JOIN lined ON string_split(url, '#')[1] = page QUALIFY place <= 12""")
def f8(spark, sf_dir):
    from groundtable.sources.corpus import sections

    page = lambda n: F.concat(F.lit("https://docs.example.org/"), (n % 50).cast("string"))
    lines = sections(table(spark, sf_dir, "documents"))
    url = F.concat(page(F.col("doc_id")), F.lit("#"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")))
    parts = lines.select(url.alias("source_url"), url.alias("chunk_id"), F.col("ord").alias("ordinal"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.concat(page(F.col("item_id")), F.lit("#top")).alias("url"))
    return fusion.page_chunks(asked, parts).select("request_id", F.col("source_url").alias("url"), "place")


@query("F9_pin_page", f"""WITH {FUSED_SQL}, pins AS (SELECT question_id, chunk_id, place FROM fused WHERE place IN (3, 9)),
  both_parts AS (SELECT question_id, chunk_id, 0 AS part, place FROM pins UNION ALL SELECT question_id, chunk_id, 1, final FROM results ANTI JOIN pins USING (question_id, chunk_id)),
  n AS (SELECT *, count(*) FILTER (part = 0) OVER (PARTITION BY question_id) AS pins, row_number() OVER (PARTITION BY question_id ORDER BY part, place, chunk_id) AS final FROM both_parts)
  SELECT question_id, chunk_id, final FROM n WHERE final <= pins + 6""")
def f9(spark, sf_dir):
    fused = fusion.fuse_ranks(ranked(spark, sf_dir))
    found = fusion.anchored(fused).select("question_id", "chunk_id", F.col("final").alias("place"))
    return fusion.pin_page(fused.where("place IN (3, 9)"), found)


@query("F10_external_ranking", f"""WITH {FUSED_SQL}, picks AS (SELECT question_id, unnest([4, 2, 4, 99]) AS pick, unnest([1, 2, 3, 4]) AS pick_rank FROM questions),
  first AS (SELECT question_id, pick, min(pick_rank) AS pick_rank FROM picks GROUP BY ALL)
  SELECT f.question_id, chunk_id, place, row_number() OVER (PARTITION BY f.question_id ORDER BY pick_rank NULLS LAST, place) AS final
  FROM fused f LEFT JOIN first p ON f.question_id = p.question_id AND place = pick QUALIFY final <= 6""")
def f10(spark, sf_dir):
    fused = fusion.fuse_ranks(ranked(spark, sf_dir))
    picks = questions(spark, sf_dir).select(
        "question_id", F.inline(F.array(*[F.struct(F.lit(p).alias("pick"), F.lit(i + 1).alias("pick_rank")) for i, p in enumerate((4, 2, 4, 99))]))
    )
    return fusion.external_ranking(fused, picks).select("question_id", "chunk_id", "place", "final")


@query("F11_escalates", f"""WITH {GATED_SQL} SELECT g.question_id, (sure OR together) AND
    (NOT (coalesce(best_cosine, 0) >= 0.78 AND overlap >= 5 AND coverage >= 0.9) OR regexp_matches(question, '(?i)\\b(vs|versus|compare|compared|difference between)\\b')
     OR length(question) - length(replace(question, '?', '')) >= 2) AS escalate FROM gated g JOIN questions USING (question_id)""")
def f11(spark, sf_dir):
    joined = gated(spark, sf_dir).join(questions(spark, sf_dir), "question_id")
    return joined.select("question_id", fusion.escalates(F.col("pass"), F.col("question")).alias("escalate"))


@query("F13_search_results", f"""WITH {FUSED_SQL}, {REGISTRY_SQL} SELECT question_id, final, chunk_id, CASE WHEN can_excerpt AND mode = 'full' THEN sha256(text) END AS excerpt_hash
  FROM results JOIN chunks USING (chunk_id) LEFT JOIN registry USING (source_id)""")
def f13(spark, sf_dir):
    found = fusion.hydrate(results(spark, sf_dir), corpus(spark, sf_dir))
    masked = fusion.search_results(found, source_registry(table(spark, sf_dir, "documents")))
    return masked.select("question_id", "final", "chunk_id", F.sha2("excerpt", 256).alias("excerpt_hash"))


@query("F14_unknown_sources", f"WITH {REGISTRY_SQL} SELECT item_id, 'src' || item_id AS source_id FROM benchmark WHERE 'src' || item_id NOT IN (SELECT source_id FROM registry)")
def f14(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("source_id"))
    return fusion.unknown_sources(asked, source_registry(table(spark, sf_dir, "documents"))).select("item_id", "source_id")


# retrieval quality


TRUTH_SQL = "truth AS (SELECT item_id AS question_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
QUALITY_SQL = f"""WITH {FUSED_SQL}, listed AS (SELECT question_id, leg AS kind, rank, chunk_id FROM ranked UNION ALL SELECT question_id, 'hybrid', final, chunk_id FROM results),
  expected AS (SELECT question_id, chunk_id FROM (SELECT b.item_id AS question_id, c.chunk_id FROM benchmark b JOIN chunks c ON contains(c.text, b.text))),
  hit AS (SELECT question_id, kind, min(rank) AS rank FROM listed JOIN expected USING (question_id, chunk_id) GROUP BY ALL),
  grid AS (SELECT question_id, unnest(['keyword', 'semantic', 'hybrid']) AS kind FROM (SELECT DISTINCT question_id FROM expected))
  SELECT kind, count(*) AS questions, round(avg(CASE WHEN rank <= 6 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
  FROM grid LEFT JOIN hit USING (question_id, kind) GROUP BY kind"""


@query("E1_retrieval_quality", QUALITY_SQL)
def e1(spark, sf_dir):
    from groundtable.operators.evaluation import passage_truth, retrieval_quality

    listed = ranked(spark, sf_dir)
    found = fusion.anchored(fusion.fuse_ranks(listed))
    kinds = listed.select("question_id", F.col("leg").alias("kind"), "rank", "chunk_id").unionByName(
        found.select("question_id", F.lit("hybrid").alias("kind"), F.col("final").alias("rank"), "chunk_id")
    )
    return retrieval_quality(kinds, passage_truth(questions(spark, sf_dir), corpus(spark, sf_dir)))


@query("X5_term_coverage", f"WITH {FUSED_SQL}, {COVERAGE_SQL} SELECT question_id, round(coverage, 6) AS coverage FROM coverage")
def x5(spark, sf_dir):
    return _round(gated(spark, sf_dir), "coverage").select("question_id", "coverage")


_DEEP_SQL = f"""regexp_matches(text, '(?i){T.COMPARES}') OR length(text) - length(replace(text, '?', '')) > 1 OR (regexp_matches(text, '(?i){T.SEVERAL}') AND length(text) > 90) OR length(text) > 180"""
_INTENT_SQL = f"""CASE WHEN {_any_sql([T.RULE_PATTERN])} THEN 'lookup' WHEN {_any_sql(T.DEBUG_PATTERNS)} THEN 'debug' WHEN {_any_sql(T.ADVICE_PATTERNS)} THEN 'advice' WHEN {_any_sql(T.LOOKUP_PATTERNS)} THEN 'lookup' ELSE 'advice' END"""


@query("X11_flags", f"""SELECT conv_id, turn, regexp_matches(text, '(?i){T.GREETING}') AS greeting, {_any_sql(T.CODE_REQUESTS)} AS code, regexp_matches(text, '(?i){T.UNINDEXED}') AS unindexed,
  conv_id % 2 = 0 AND regexp_matches(text, '(?i){T.REGULATORY}') AS regulatory, {_any_sql(T.CODE_REQUESTS)} OR {_INTENT_SQL} <> 'lookup' OR {_DEEP_SQL} OR turn >= 4 AS deep
  FROM conversations WHERE role = 'user'""")
def x11(spark, sf_dir):
    turns, text = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("text")
    names = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("Competition Manual"))).otherwise(F.array(F.lit("Game Manual 0")))
    return turns.select(
        "conv_id", "turn", T.is_greeting(text).alias("greeting"), T.code_request(text).alias("code"), T.unindexed_library(text).alias("unindexed"),
        T.regulatory_question(text, F.array().cast("array<string>"), names).alias("regulatory"), T.needs_depth(text, F.col("turn"), T.code_request(text)).alias("deep"),
    )


_LIBRARY_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Pedro Pathing ' WHEN 1 THEN 'road runner ' WHEN 2 THEN 'ftclib ' ELSE '' END"
_ASK_SQL = "CASE doc_id % 7 WHEN 0 THEN 'where do I find the version? ' WHEN 1 THEN '' ELSE 'import it ' END"
_NAMED_SQL = "CASE doc_id % 5 WHEN 0 THEN ' version 2' WHEN 1 THEN ' ftclib:core:1.2' WHEN 2 THEN ' com.pedropathing:ftc:2.0.1' ELSE '' END"


@query("X15_missing_version", rf"""WITH t AS (SELECT doc_id, {_LIBRARY_SQL} || {_ASK_SQL} || text || {_NAMED_SQL} AS t FROM documents WHERE text IS NOT NULL),
  l AS (SELECT *, CASE WHEN regexp_matches(t, '(?i){T.LIBRARIES[0][0]}') THEN 'Pedro Pathing' WHEN regexp_matches(t, '(?i){T.LIBRARIES[1][0]}') THEN 'Road Runner' WHEN regexp_matches(t, '(?i){T.LIBRARIES[2][0]}') THEN 'FTCLib' END AS library FROM t)
  SELECT doc_id, CASE WHEN regexp_matches(t, '(?i){T.API_CUE}') AND NOT (regexp_matches(t, '(?i){T.FINDS_VERSION}') AND regexp_matches(t, '(?i)version'))
    AND NOT regexp_matches(t, '(?i){T.NAMED_VERSION}') THEN library END AS library FROM l""")
def x15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    asked = F.concat(F.expr(_LIBRARY_SQL), F.expr(_ASK_SQL), "text", F.expr(_NAMED_SQL))
    return docs.select("doc_id", T.missing_version(asked).alias("library"))


@query("X16_disposition", f"""WITH {GATED_SQL} SELECT question_id, CASE WHEN question_id % 11 = 0 THEN 'rate-limited' WHEN question_id % 7 = 0 THEN 'cached' WHEN (sure OR together) AND question_id % 5 <> 0 THEN 'grounded'
  WHEN sure OR together THEN 'degraded' WHEN question_id % 3 = 0 THEN 'uncovered' ELSE 'off-topic' END AS disposition FROM gated""")
def x16(spark, sf_dir):
    q = F.col("question_id")
    made = gated(spark, sf_dir).select(
        "question_id", F.lit(True).alias("valid"), F.lit(False).alias("greeting"), (q % 11 != 0).alias("admitted"), (q % 7 == 0).alias("cached"), F.lit(False).alias("unindexed_library"),
        F.col("pass").alias("passed"), (q % 5 != 0).alias("under_ceiling"), F.when(q % 3 == 0, "ftc").otherwise("off").alias("topic"),
    )
    return made.select("question_id", T.disposition().alias("disposition"))


def _encoded_sql(rows: str) -> str:
    """The DuckDB form of the hashed encoder over ``rows`` (id, tokens), a row for each component."""
    return f"""terms_e AS (SELECT id, unnest(tokens) AS term FROM {rows}), counts_e AS (
    SELECT id, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 64 AS place, count(*)::DOUBLE AS n FROM terms_e GROUP BY ALL
  ), norms_e AS (SELECT id, sqrt(sum(n * n)) AS norm FROM counts_e GROUP BY id)
  SELECT r.id, p.place, round(coalesce(n / norm, 0), 6) AS value FROM {rows} r CROSS JOIN (SELECT unnest(range(64)) AS place) p
    LEFT JOIN counts_e c ON c.id = r.id AND c.place = p.place LEFT JOIN norms_e m ON m.id = r.id"""


_INSTRUCTION = "Represent this question for searching passages: "


@query("V2_encoded", f"WITH {CHUNKS_SQL}, rows_e AS (SELECT chunk_id AS id, {tokens_sql('text')} AS tokens FROM chunks), {_encoded_sql('rows_e')}")
def v2(spark, sf_dir):
    made = vectors.hashed_vectors(corpus(spark, sf_dir), "chunk_id", "text")
    return made.select(F.col("chunk_id").alias("id"), F.posexplode("vector").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("V2_encoded_questions", f"WITH rows_e AS (SELECT item_id AS id, {tokens_sql(f"('{_INSTRUCTION}' || text)")} AS tokens FROM benchmark WHERE text IS NOT NULL), {_encoded_sql('rows_e')}")
def v2_questions(spark, sf_dir):
    made = vectors.hashed_vectors(questions(spark, sf_dir), "question_id", "question", prefix=_INSTRUCTION)
    return made.select(F.col("question_id").alias("id"), F.posexplode("vector").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("V8_approximate_top")
def v8(spark, sf_dir):
    all_rows = spill(_vectors(spark, sf_dir), "unit-vectors")
    return _round(vectors.approximate_top(all_rows.where("id % 100 = 0"), all_rows, 10), "score")


@query("V8_all_lists", _top_sql(False))
def v8_all(spark, sf_dir):
    """A store of 16 lists with every list probed finds what the exact search finds."""
    all_rows = spill(_vectors(spark, sf_dir), "unit-vectors")
    return _round(vectors.approximate_top(all_rows.where("id % 100 = 0"), all_rows, 10, lists=16, probes=16), "score")


@query("L8_section_summary", rf"""WITH {CHUNKS_SQL} SELECT source_id, page_title, count(*) AS sections, CAST(sum(char_len) AS BIGINT) AS chars, min(ordinal) AS first_ordinal,
  bool_or(regexp_matches(page_title, '(?i)\b(game|season)\b')) AS game_published FROM chunks GROUP BY ALL""")
def l8(spark, sf_dir):
    from groundtable.operators.logs import section_summary

    return section_summary(corpus(spark, sf_dir))
