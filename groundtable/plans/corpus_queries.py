"""Registered queries of sources, sections, chunking and publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundtable.operators import chunking, publication, vectors
from groundtable.plans.registry import query, table
from groundtable.plans.shared import shared_path
from groundtable.sources import corpus, pages

_SEC, _CH, _REG = corpus.SECTIONS_SQL, corpus.CHUNKS_SQL, corpus.REGISTRY_SQL


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _sections(spark, sf_dir):
    return corpus.sections(_docs(spark, sf_dir))


@query("S1_source_registry", f"WITH {_REG} SELECT * FROM registry")
def s1(spark, sf_dir):
    return corpus.source_registry(_docs(spark, sf_dir))


ADAPTERS = corpus.SourceAdapters()


@ADAPTERS.add("prose")
def prose(spark, path):
    docs = table(spark, path, "documents")
    return docs.select(F.format_string("docs/%d", F.col("doc_id")).alias("doc_path"), corpus.first_words("text", 6).alias("page_title"), "text")


@ADAPTERS.add("talks")
def talks(spark, path):
    turns = table(spark, path, "conversations")
    return turns.select(F.format_string("talks/%d/%d", F.col("conv_id"), F.col("turn")).alias("doc_path"), F.col("role").alias("page_title"), "text")


@query("U1_source_adapters", r"""WITH r AS (SELECT 'prose' AS source_id, 'docs/' || doc_id AS doc_path, array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 6), ' ') AS page_title, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'talks', 'talks/' || conv_id || '/' || turn, role, text FROM conversations WHERE text IS NOT NULL)
  SELECT source_id || ':' || substr(sha256(doc_path || '#root:1'), 1, 16) AS chunk_id, source_id, doc_path, page_title, sha256(text) AS content_hash, CAST(length(text) AS INTEGER) AS char_len FROM r""")
def u1(spark, sf_dir):
    return ADAPTERS.load(spark, sf_dir).drop("text")


_ARTICLE_SQL = r"regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)"
_STRIP_SQL = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ARTICLE_SQL},
  '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>', '', 'g'),
  '(?i)</(?:p|div|h[1-6]|li|section)>|<br */?>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g')"""
_TEXT_SQL = f"trim(replace(replace(replace(replace(replace({_STRIP_SQL}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), chr(32) || chr(10))"


@query("S2_page_articles", f"SELECT page_id, url, t AS text FROM (SELECT page_id, url, {_TEXT_SQL} AS t FROM pages) WHERE length(t) >= 120")
def s2(spark, sf_dir):
    return pages.articles(table(spark, sf_dir, "pages"))


@query("S3_sections", f"WITH {_SEC} SELECT * FROM sections")
def s3(spark, sf_dir):
    return _sections(spark, sf_dir)


@query("S3_page_headings", r"SELECT page_id, CAST(list_position(h, t) - 1 AS INTEGER) AS place, t AS title FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages), unnest(h) u(t)")
def s3_headings(spark, sf_dir):
    return pages.headings(table(spark, sf_dir, "pages")).select("page_id", "place", "title")


@query("S3_page_sections", r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>|<!--.*?-->', '', 'g') AS h FROM pages),
  p AS (SELECT page_id, list_slice(string_split(regexp_replace(h, '(?i)(<h[1-6][\s>])', chr(2) || '\1', 'g'), chr(2)), 2, 1000000) AS parts FROM t),
  r AS (SELECT page_id, i - 1 AS ord, parts[i] AS part FROM p, unnest(range(1, len(parts) + 1)) u(i)),
  s AS (SELECT page_id, ord, CAST(regexp_extract(part, '(?is)^<h([1-6])', 1) AS INTEGER) AS level, regexp_extract(part, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS title,
    string_split(regexp_replace(regexp_extract(part, '(?is)^<h[1-6][^>]*>.*?</h[1-6]>(.*)$', 1), '(?i)</(?:p|div|li|section|article)>|<br */?>|<p[\s>]', chr(1), 'g'), chr(1)) AS blocks
    FROM r WHERE regexp_matches(part, '(?is)^<h[1-6][^>]*>.*?</h[1-6]>'))
  SELECT page_id, CAST(ord AS INTEGER) AS ord, level, PLAIN(title) AS title, '' AS anchor, array_to_string(list_filter(list_transform(blocks, lambda b: PLAINB), lambda b: b <> ''), chr(10) || chr(10)) AS body FROM s"""
  .replace("PLAIN(title)", r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))""")
  .replace("PLAINB", r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '^[^<>]*>', ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"""))
def s3_bodies(spark, sf_dir):
    return pages.page_sections(table(spark, sf_dir, "pages"))


@query("S4_path_filter", r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/(de|es)/') AND NOT contains(url, '?') AND regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^(1|2)')")
def s4(spark, sf_dir):
    return pages.path_filter(table(spark, sf_dir, "pages"), skip=("/(de|es)/", r"\?"), only="/(en|fr)/", names="^(1|2)").select("page_id", "url")


_BOARD = """<script type="application/json">{"board":{"name":"b","config":{"isPublic":%s}},"questions":[{"number":%d,"questionId":"q","status":"%s","title":"t","content":"%s","answer":{"questionId":"%s","content":"a","modifiedAt":%d}},{"number":1,"questionId":"r","status":"ANSWERED","answer":{"questionId":"r","content":"b","modifiedAt":0}}]}</script>"""


def _boards(spark, sf_dir):
    """Every page of the page table as a board: some are private, some questions open, misplaced or repeated."""
    n = F.col("page_id")
    body = F.format_string(_BOARD, F.when(n % 7 == 0, "false").otherwise("true"), (n % 5).cast("int"), F.when(n % 3 == 0, "OPEN").otherwise("ANSWERED"), "url", F.when(n % 11 == 0, "x").otherwise("q"), n * 1000)
    return table(spark, sf_dir, "pages").select("page_id", body.alias("html"))


_BOARD_SQL = """b AS (SELECT page_id, CAST(page_id % 5 AS INTEGER) AS number, url AS content, 'a' AS answer, page_id AS second FROM pages WHERE page_id % 7 <> 0 AND page_id % 3 <> 0 AND page_id % 11 <> 0
  UNION ALL SELECT page_id, 1, NULL, 'b', 0 FROM pages WHERE page_id % 7 <> 0), c AS (SELECT *, count(*) OVER (PARTITION BY page_id, number) AS copies FROM b)"""


@query("S5_board_answers", f"WITH {_BOARD_SQL} SELECT page_id, number, content, answer, second FROM c WHERE copies = 1")
def s5(spark, sf_dir):
    return pages.board_answers(_boards(spark, sf_dir)).select("page_id", "number", "content", "answer", F.unix_seconds("modified_at").alias("second"))


@query("S5_board_rejects", f"WITH {_BOARD_SQL} SELECT DISTINCT page_id, number, copies FROM c WHERE copies > 1")
def s5_rejects(spark, sf_dir):
    return pages.board_rejects(_boards(spark, sf_dir))


@query("S6_outline", r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CAST((i - 1) % 3 + 1 AS INTEGER) AS level, trim(regexp_replace(l[i], '^\s*[-*]\s*', '')) AS title
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) t(i) WHERE trim(l[i], ' ') <> ''""")
def s6(spark, sf_dir):
    """Documents as outlines: line by line the indent grows by two, up to four."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when(F.trim(line) == "", "").otherwise(F.concat(F.repeat(F.lit("  "), i % 3), F.lit("- "), F.ltrim(line))))
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    return pages.outline(docs.select("doc_id", F.array_join(lines, "\n").alias("text")))


@query("S7_sitemap", "SELECT page_id, CAST(i AS INTEGER) AS place, CASE i WHEN 0 THEN url ELSE url || '/next' END AS loc, page_id % 4 = 0 AS is_index FROM pages, (SELECT unnest([0, 1]) AS i)")
def s7_sitemap(spark, sf_dir):
    root = F.when(F.col("page_id") % 4 == 0, "sitemapindex").otherwise("urlset")
    body = F.format_string("<%s><url><loc> %s </loc></url><url><loc>%s/next</loc></url></%s>", root, "url", "url", root)
    return pages.sitemap(table(spark, sf_dir, "pages").select("page_id", body.alias("html")))


_CODE_HEAD = "/* Copyright. Redistribution and use in source are permitted. */\n"


@query("S9_code_chunks", r"""WITH f AS (SELECT doc_id, ['Concept', 'Robot', 'Sensor', 'Basic'][doc_id % 4 + 1] || doc_id AS name, ['concept', 'robot', 'sensor', 'basic'][doc_id % 4 + 1] AS kind,
    replace(string_split(text, chr(10))[1], '*/', '* /') AS d, 'class A {' || chr(10) || '// ' || replace(text, '*/', '* /') || chr(10) || '}' AS c FROM documents WHERE text IS NOT NULL),
  g AS (SELECT *, regexp_replace(regexp_replace(' ' || d, '^[ \t]*\*[ \t]?', ''), '^\s+|\s+$', '', 'g') AS description, '/** ' || d || chr(10) || ' */' || chr(10) || c AS code FROM f)
  SELECT name, kind, CASE WHEN doc_id % 5 = 0 THEN 'electronics' ELSE 'programming' END AS category, description,
    '# SDK Samples' || chr(10) || '## ' || name || ' (official sample OpMode, ' || kind || ')' || chr(10) || chr(10) || description || chr(10) || chr(10) || '```java' || chr(10) || substr(code, 1, 6000) || chr(10) || '```' AS text FROM g""")
def s9(spark, sf_dir):
    """A file per document: its first line as the comment, all of its text as code, comment signs in it included."""
    docs = _docs(spark, sf_dir).where(F.col("text").isNotNull())
    name = F.concat(F.element_at(F.array(*[F.lit(k) for k in ("Concept", "Robot", "Sensor", "Basic")]), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"))
    safe = lambda c: F.replace(c, F.lit("*/"), F.lit("* /"))
    body = F.concat(F.lit(_CODE_HEAD + "/** "), safe(F.get(F.split("text", "\n"), 0)), F.lit("\n */\nclass A {\n// "), safe(F.col("text")), F.lit("\n}"))
    files = docs.select(name.alias("name"), body.alias("text"))
    categories = docs.where("doc_id % 5 = 0").select(name.alias("name"), F.lit("electronics").alias("category"))
    return pages.code_chunks(files, categories=categories)


@query("S10_api_chunks", r"""WITH d AS (SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 1200) AS d, doc_id % 50 AS m, substr(trim(regexp_replace(substr(text, 1, 60), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 60) AS w FROM documents WHERE text IS NOT NULL)
  SELECT doc_id AS page_id, 'com.x' || doc_id % 7 AS package, 'C' || doc_id AS name, '# SDK API' || chr(10) || '## com.x' || doc_id % 7 || '.C' || doc_id || chr(10) || chr(10) || d || chr(10) || chr(10)
    || CASE WHEN m > 0 THEN 'Methods:' || chr(10) || array_to_string(list_transform(range(least(m, 40)), lambda i: '- get' || i || '(int a) — ' || w), chr(10)) ELSE '' END AS text FROM d WHERE length(d) >= 40 OR m > 0""")
def s10(spark, sf_dir):
    """A class page per document: its whole text, signs of markup escaped, as description and up to 49 methods, so both limits are met."""
    docs = _docs(spark, sf_dir).where(F.col("text").isNotNull())
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.concat(F.lit('(<i>int</i> a)</code> <td> <div class="block">'), escaped(F.substring("text", 1, 60)), F.lit("</div>"))
    method = lambda i: F.concat(F.lit('<code><a href="#">get'), i.cast("string"), F.lit("</a>"), first)
    listed = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 50 - 1).cast("int")), method), ""))
    body = F.concat(F.lit('<section class="class-description"><p>'), escaped(F.col("text")), F.lit("</p></section>"), listed)
    path = F.format_string("Core/com/x%d/C%d.html", F.col("doc_id") % 7, F.col("doc_id"))
    return pages.api_chunks(docs.select(F.col("doc_id").alias("page_id"), path.alias("path"), body.alias("html")))


@query("S12_staged_publication", None)
def s12(spark, sf_dir):
    """Forward and rollback changes of two snapshots staged with checksums; chunks written by source, then one source replaced."""
    before, after = _snapshots(spark, sf_dir)
    path = shared_path(spark, "s12")
    pages.write_chunks(before, f"{path}/chunks")
    pages.write_chunks(after.where("source_id = 'src1'"), f"{path}/chunks")
    staged = pages.stage_publication(publication.delta(before, after), publication.delta(after, before), path)
    kept = spark.read.schema(before.schema).json(f"{path}/chunks").groupBy("source_id").agg(F.count("*").alias("rows"))
    return staged.unionByName(kept.select(F.concat(F.lit("chunks/"), "source_id").alias("artefact"), "rows", F.lit(None).cast("string").alias("checksum")))


@query("S7_page_links", r"""WITH l AS (SELECT page_id, i, a[i] AS href, b[i] AS title FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS a,
  regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS b FROM pages), unnest(range(1, len(a) + 1)) t(i))
  SELECT href, arg_min(title, page_id * 100000 + i) AS title, count(*) AS links FROM l GROUP BY href""")
def s7(spark, sf_dir):
    return pages.first_titles(pages.links(table(spark, sf_dir, "pages")))


@query("S7_page_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' [|-] [^|-]*$', '')) AS title FROM pages")
def s7_titles(spark, sf_dir):
    return pages.titles(table(spark, sf_dir, "pages")).select("page_id", "title")


@query("S8_link_chunks", f"""WITH {_CH}, {_REG} SELECT chunk_id, '# ' || source_name || chr(10) || '## ' || section_title || chr(10) || chr(10) || source_name || ' documents this at "' || page_title
  || '". The text of this page is not reproduced here; open the link to read it.' AS text FROM chunks JOIN registry USING (source_id) WHERE mode = 'link'""")
def s8(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return pages.link_chunks(corpus.chunks(docs), corpus.source_registry(docs)).select("chunk_id", "text")


@query("S11_symbols", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]{2,}\b')) AS name FROM documents)
  SELECT name, CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9_]+') THEN 'constant' WHEN regexp_full_match(name, '[A-Z][A-Za-z0-9]*') THEN 'type' ELSE 'method' END AS kind FROM w""")
def s11(spark, sf_dir):
    return pages.symbols(_docs(spark, sf_dir))


@query("S13_missing_sources", f"""WITH {_CH}, {_REG} SELECT source_id, 'no chunks' AS problem FROM (SELECT source_id FROM registry UNION ALL SELECT 'src-unused') WHERE source_id NOT IN (SELECT source_id FROM chunks)
  UNION ALL SELECT NULL, 'incomplete corpus' FROM chunks HAVING count(*) < 1000000000""")
def s13(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    registry = corpus.source_registry(docs).select("source_id")
    return pages.missing_sources(registry.unionByName(registry.limit(1).select(F.lit("src-unused").alias("source_id"))), corpus.chunks(docs), minimum=1_000_000_000)


_LEVELS = range(1, 6)
_PATH_SQL = f"""{_SEC}, marked AS (SELECT *, {', '.join(f"max(CASE WHEN level = {l} THEN {{'o': ord, 't': title}} END) OVER w AS l{l}" for l in _LEVELS)}
  FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pathed AS (SELECT doc_id, ord, level, title, body, array_to_string(list_filter([{', '.join(
    f"CASE WHEN level > {l} AND coalesce(l{l}.o, -1) > greatest(-1, {', '.join(f'coalesce(l{m}.o, -1)' for m in range(1, l)) or '-1'}) THEN l{l}.t END" for l in _LEVELS)}, title],
  lambda x: x IS NOT NULL), ' > ') AS heading_path FROM marked)"""


@query("C1_heading_paths", f"WITH {_PATH_SQL} SELECT doc_id, ord, heading_path FROM pathed")
def c1(spark, sf_dir):
    return chunking.heading_paths(_sections(spark, sf_dir)).select("doc_id", "ord", "heading_path")



@query("C2_merge_thin", f"""WITH RECURSIVE {_SEC}, fold AS (
    SELECT doc_id, ord, ord AS start, trim(body, ' ') AS body FROM sections WHERE ord = 0
    UNION ALL
    SELECT f.doc_id, s.ord, CASE WHEN joins THEN f.start ELSE s.ord END, CASE WHEN joins THEN CASE WHEN f.body = '' THEN s.b WHEN s.b = '' THEN f.body ELSE f.body || chr(10) || chr(10) || s.b END ELSE s.b END
    FROM (SELECT fold.*, s2.ord AS next_ord, trim(s2.body, ' ') AS b, length(fold.body) < 240 AND length(fold.body) + length(trim(s2.body, ' ')) < 2200 AS joins
          FROM fold JOIN sections s2 ON s2.doc_id = fold.doc_id AND s2.ord = fold.ord + 1) f, LATERAL (SELECT f.next_ord AS ord, f.b AS b) s)
  SELECT doc_id, start AS ord, arg_max(body, ord) AS body FROM fold GROUP BY doc_id, start""")
def c2(spark, sf_dir):
    return chunking.merge_thin(_sections(spark, sf_dir))


@query("C3_keep_units", rf"WITH {_SEC} SELECT doc_id, ord FROM sections WHERE length(trim(regexp_replace(body, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) >= 80")
def c3(spark, sf_dir):
    return chunking.keep_units(_sections(spark, sf_dir)).select("doc_id", "ord")


@query("C4_atoms", r"""WITH f AS (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '(?m)^```') AS f FROM documents WHERE text IS NOT NULL),
  a AS (SELECT doc_id, flatten([CASE WHEN i % 2 = 0 THEN ['```' || f[i] || '```'] ELSE list_filter(list_transform(string_split_regex(f[i], '\n[ \t]*(?:\n[ \t]*)+'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END FOR i IN range(1, len(f) + 1)]) AS a FROM f)
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, a[i] AS atom FROM a, unnest(range(1, len(a) + 1)) t(i)""")
def c4(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(chunking.atoms(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("place", "atom"))


_ID_SQL = "regexp_replace(regexp_replace(regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '^[0-9]+-*', '')"


def _split_sql(rows: str) -> str:
    """CTEs from ``rows`` (key, body) to pieces (key, part, piece): atoms, fences whole, and the fold that packs them."""
    return rf"""fences AS (SELECT key, body, string_split_regex(body, '(?m)^```') AS f FROM {rows}),
  atoms AS (SELECT key, body, flatten([CASE WHEN i % 2 = 0 THEN ['```' || f[i] || '```'] ELSE list_filter(list_transform(string_split_regex(f[i], '\n[ \t]*(?:\n[ \t]*)+'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END FOR i IN range(1, len(f) + 1)]) AS a FROM fences WHERE length(body) > 3600),
  fold AS (SELECT key, 1 AS i, 1 AS part, length(a[1]) + 2 AS len FROM atoms WHERE len(a) > 0
    UNION ALL SELECT t.key, i + 1, CASE WHEN len + length(a[i + 1]) + 2 > 2400 THEN part + 1 ELSE part END,
      CASE WHEN len + length(a[i + 1]) + 2 > 2400 THEN length(a[i + 1]) + 2 ELSE len + length(a[i + 1]) + 2 END FROM fold JOIN atoms t USING (key) WHERE i < len(a)),
  pieces AS (SELECT key, part, string_agg(a[i], chr(10) || chr(10) ORDER BY i) AS piece FROM fold JOIN atoms USING (key) GROUP BY key, part
    UNION ALL SELECT key, 1, body FROM {rows} WHERE length(body) <= 3600)"""


@query("C5_split_oversize", f"""WITH RECURSIVE b AS (SELECT doc_id AS key, replace(text, chr(10), chr(10) || chr(10)) AS body FROM documents WHERE text IS NOT NULL), {_split_sql('b')}
  SELECT key AS doc_id, part, length(piece) AS chars FROM pieces""")
def c5(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text IS NOT NULL").withColumn("body", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return docs.select("doc_id", F.posexplode(chunking.split_oversize(F.col("body"))).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("part"), F.length("p").alias("chars"))


_UNITS_SQL = rf"""{_SEC}, fenced AS (SELECT *, coalesce(count(*) FILTER (starts_with(body, '```')) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS open FROM sections),
  cut AS (SELECT *, count(*) FILTER (ord % 16 = 0 AND open) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS unit FROM fenced),
  units AS (SELECT doc_id, CAST(unit AS INTEGER) AS ord, CAST(unit % 4 + 1 AS INTEGER) AS level, arg_min(title, ord) AS title, string_agg(body, chr(10) || chr(10) ORDER BY ord) AS body FROM cut GROUP BY doc_id, unit),
  {_PATH_SQL.split(_SEC + ', ', 1)[1].replace('FROM sections', 'FROM units')},
  kept AS (SELECT doc_id * 10000 + ord AS key, * FROM pathed WHERE length(trim(regexp_replace(body, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) >= 80)"""


@query("C8_rendered_chunks", f"""WITH RECURSIVE {_UNITS_SQL}, {_split_sql('kept')},
  counted AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM pieces),
  named AS (SELECT k.doc_id, k.ord, c.part, c.n, c.piece, k.heading_path, k.title, array_to_string(list_slice(regexp_split_to_array(d.text, '[ \\n]+'), 1, 6), ' ') AS page_title FROM counted c JOIN kept k USING (key) JOIN documents d ON d.doc_id = k.doc_id),
  a AS (SELECT *, {_ID_SQL} AS anchor FROM named)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, part) - 1 AS INTEGER) AS ordinal, CAST(CASE WHEN n > 1 THEN part ELSE 0 END AS INTEGER) AS part, CAST(n AS INTEGER) AS part_count,
    CASE WHEN heading_path <> '' AND heading_path <> page_title THEN '# ' || page_title || chr(10) || '## ' || heading_path ELSE '# ' || page_title END
      || CASE WHEN n > 1 THEN ' (part ' || part || ' of ' || n || ')' ELSE '' END || chr(10) || chr(10) || piece AS text,
    'https://docs.example.org/' || doc_id || CASE WHEN anchor <> '' THEN '#' || anchor ELSE '' END AS source_url FROM a""")
def c8(spark, sf_dir):
    """Units begin at every sixteenth line outside fences and hold their lines as paragraphs; C3's least is their only bound."""
    docs = _docs(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy("ord")
    fences = F.coalesce(F.count_if(F.col("body").startswith("```")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = corpus.sections(docs).withColumn("starts", (F.col("ord") % 16 == 0) & (fences % 2 == 0))
    placed = starts.withColumn("unit", F.count_if("starts").over(order) - 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda line: line["body"])
    units = placed.groupBy("doc_id", F.col("unit").alias("ord")).agg(F.min_by("title", "ord").alias("title"), F.array_join(lines, "\n\n").alias("body"))
    kept = chunking.keep_units(chunking.heading_paths(units.withColumn("level", F.col("ord") % 4 + 1)))
    named = docs.select("doc_id", corpus.first_words("text", 6).alias("page_title"), F.format_string("https://docs.example.org/%d", F.col("doc_id")).alias("page_url"))
    return chunking.rendered_chunks(kept.join(named, "doc_id").withColumn("anchor", chunking.anchor_id(F.col("title"))))


@query("C9_tidy_title")
def c9(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "ord", chunking.tidy_title(F.col("title")).alias("title"))


def _pack_sql(name: str, rows: str, joint: int) -> str:
    """CTEs from ``rows`` (key, a: pieces in order) to ``name`` (key, part, piece): packed to 2,600 characters, a piece never cut."""
    return f"""{name}_fold AS (SELECT key, 1 AS i, 1 AS part, length(a[1]) + {joint} AS len FROM {rows} WHERE len(a) > 0
    UNION ALL SELECT t.key, i + 1, CASE WHEN len + length(a[i + 1]) > 2600 THEN part + 1 ELSE part END, CASE WHEN len + length(a[i + 1]) > 2600 THEN 0 ELSE len END + length(a[i + 1]) + {joint}
      FROM {name}_fold JOIN {rows} t USING (key) WHERE i < len(a)),
  {name} AS (SELECT key, part, string_agg(a[i], repeat(chr(10), {joint}) ORDER BY i) AS piece FROM {name}_fold JOIN {rows} USING (key) GROUP BY key, part)"""


_RULE_UNITS_SQL = rf"""whole AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^[A-Z]{{1,2}}\d{{2,3}}\s') THEN string_split(regexp_replace(text, '\n([A-Z]{{1,2}}\d{{2,3}}\s)', chr(2) || '\1', 'g'), chr(2))
    ELSE string_split_regex(text, '\n\s*\n') END AS u FROM documents WHERE text IS NOT NULL),
  units AS (SELECT doc_id, i, u[i] AS unit FROM whole, unnest(range(1, len(u) + 1)) t(i)),
  long AS (SELECT doc_id * 1000000 + i AS key, string_split(unit, chr(10)) AS a FROM units WHERE length(unit) > 3600), {_pack_sql('repacked', 'long', 1)},
  rule_units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS place, unit FROM (SELECT doc_id, i, 1 AS part, unit FROM units WHERE length(unit) <= 3600
    UNION ALL SELECT key // 1000000, key % 1000000, part, piece FROM repacked))"""


@query("C6_rule_units", f"WITH RECURSIVE {_RULE_UNITS_SQL} SELECT doc_id, CAST(place AS INTEGER) AS place, unit FROM rule_units")
def c6(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(chunking.rule_units(F.col("text"))).alias("place", "unit"))


@query("C6_rule_parts", f"""WITH RECURSIVE {_RULE_UNITS_SQL}, ordered AS (SELECT doc_id AS key, list(unit ORDER BY place) AS a FROM rule_units GROUP BY doc_id), {_pack_sql('packed', 'ordered', 2)}
  SELECT key AS doc_id, CAST(part - 1 AS INTEGER) AS place, piece AS part FROM packed""")
def c6_parts(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(chunking.rule_parts(F.col("text"))).alias("place", "part"))


def _manuals(spark, sf_dir):
    """Documents as manuals: every fifth line opens a numbered section, every seventh is a row of contents, and some lines a rule."""
    number = lambda i: F.concat(F.lit(" "), (10 + i % 80).cast("string"), F.lit("  Section "), i.cast("string"))
    line = lambda x, i: F.when(i % 7 == 6, F.lit("12  Contents ........ 5")).when(i % 5 == 0, number(i)).when(i % 3 == 0, F.concat(F.lit("R"), (100 + i % 900).cast("string"), F.lit(" "), x)).otherwise(x)
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("C7_manual_sections", r"""WITH l AS (SELECT doc_id, i - 1 AS i, x[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) t(i)),
  k AS (SELECT *, i % 5 = 0 AS head, CASE WHEN i % 3 = 0 THEN 'R' || (100 + i % 900) || ' ' || x ELSE x END AS t FROM l WHERE i % 7 <> 6),
  o AS (SELECT doc_id, i, head, regexp_replace(t, '\s+$', '') AS t FROM k WHERE head OR NOT regexp_matches(t, '\.{5,}\s*\d+\s*$')),
  p AS (SELECT *, head OR regexp_matches(t, '^\s{0,6}(?:(\d{2}(?:\.\d{1,2}){0,2})\s+|(\d(?:\.\d{1,2}){0,2})\s{2,})([A-Z][^\n]{2,80}?)\s*$') AS h FROM o),
  q AS (SELECT *, CAST(count(*) FILTER (h) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS place FROM p),
  s AS (SELECT doc_id, place, bool_or(h AND NOT head) AS strange, max(i) FILTER (head) AS i, regexp_replace(coalesce(string_agg(regexp_replace(t, '^\s{0,12}', ''), chr(10) ORDER BY i) FILTER (NOT h AND trim(t, ' ') <> ''), ''), '^\s+|\s+$', '', 'g') AS body FROM q WHERE place > 0 GROUP BY ALL)
  SELECT doc_id, place, CAST(10 + i % 80 AS VARCHAR) AS number, 'Section ' || i AS title, body FROM s WHERE length(body) >= 200 AND NOT strange""")
def c7(spark, sf_dir):
    return chunking.manual_sections(_manuals(spark, sf_dir))


@query("C7_manual_chunks")
def c7_chunks(spark, sf_dir):
    return chunking.manual_chunks(chunking.manual_sections(_manuals(spark, sf_dir)))




_LABEL_SQL = "CASE WHEN ord % 7 = 3 THEN 'My Label ' || ord % 3 WHEN ord % 7 = 5 THEN 'id' || ord % 4 WHEN ord % 7 = 6 THEN title END"


@query("C10_anchors", f"""WITH RECURSIVE {_SEC}, labelled AS (SELECT doc_id, ord, {_ID_SQL} AS base, {_ID_SQL.replace('lower(title)', f"lower(coalesce({_LABEL_SQL}, ''))")} AS label FROM sections),
  walk AS (SELECT doc_id, -1 AS ord, CAST([] AS VARCHAR[]) AS used, 0 AS serial, '' AS anchor FROM labelled WHERE ord = 0
    UNION ALL SELECT doc_id, ord, list_append(used, anchor), CASE WHEN own IS NULL THEN n ELSE serial END, anchor FROM (
      SELECT *, coalesce(own, 'id' || n) AS anchor FROM (SELECT w.doc_id, l.ord, w.used, w.serial,
        CASE WHEN label <> '' AND NOT list_contains(used, label) THEN label WHEN base <> '' AND NOT list_contains(used, base) THEN base END AS own,
        CAST(list_min(list_filter(range(serial + 1, serial + len(used) + 2), lambda i: NOT list_contains(used, 'id' || i))) AS INTEGER) AS n
        FROM walk w JOIN labelled l ON l.doc_id = w.doc_id AND l.ord = w.ord + 1)))
  SELECT doc_id, ord, anchor FROM walk WHERE ord >= 0""")
def c10(spark, sf_dir):
    """Of seven headings one has a label, one a label like a serial number and one its title as label."""
    ord = F.col("ord")
    label = F.when(ord % 7 == 3, F.concat(F.lit("My Label "), (ord % 3).cast("string"))).when(ord % 7 == 5, F.concat(F.lit("id"), (ord % 4).cast("string"))).when(ord % 7 == 6, F.col("title"))
    return chunking.allocate_anchors(_sections(spark, sf_dir).withColumn("label", label)).select("doc_id", "ord", "anchor")


_PATHS = ["common-mechanisms/drivetrains/x", "common-mechanisms/arm", "power-and-electronics", "software/concepts", "awards/a", "guides", "misc/software/"]
_PATH_OF_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "][doc_id % 7 + 1]"
_PATH_CATEGORY_SQL = " ".join(f"WHEN regexp_matches({_PATH_OF_SQL}, '{p}') THEN '{n}'" for p, n in chunking.PATH_CATEGORIES)
_CATEGORY_SQL = f"CASE {_PATH_CATEGORY_SQL} " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{n}'" for p, n in chunking.TITLE_CATEGORIES) + " ELSE 'build' END"


@query("C11_category", f"WITH {_SEC} SELECT doc_id, ord, {_CATEGORY_SQL} AS category FROM sections")
def c11(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return _sections(spark, sf_dir).select("doc_id", "ord", chunking.category(F.col("title"), path).alias("category"))


@query("C12_chunks", f"WITH {_CH} SELECT chunk_id, source_id, page_title, section_title, source_url, content_hash, CAST(char_len AS INTEGER) AS char_len, ordinal FROM chunks")
def c12(spark, sf_dir):
    return corpus.chunks(_docs(spark, sf_dir)).drop("text", "doc_id")


@query("C13_duplicate_ids", f"WITH {_CH} SELECT chunk_id, count(*) AS n FROM (SELECT source_id || ':' || substr(content_hash, 1, 16) AS chunk_id FROM chunks) GROUP BY chunk_id HAVING n > 1")
def c13(spark, sf_dir):
    by_hash = corpus.chunks(_docs(spark, sf_dir)).withColumn("chunk_id", F.concat_ws(":", "source_id", F.substring("content_hash", 1, 16)))
    return chunking.duplicate_ids(by_hash)


@query("C13_licence_escalations", f"WITH {_CH}, {_REG} SELECT chunk_id, source_id FROM chunks JOIN registry USING (source_id) WHERE doc_id % 4 = 0 AND NOT can_excerpt")
def c13_licence(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return chunking.licence_escalations(corpus.chunks(docs).withColumn("can_excerpt", F.col("doc_id") % 4 == 0), corpus.source_registry(docs))


@query("C14_length_report", f"""WITH {_CH}, p AS (SELECT source_id, char_len, row_number() OVER (PARTITION BY source_id ORDER BY char_len, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM chunks)
  SELECT source_id, count(*) AS chunks, CAST(min(char_len) AS INTEGER) AS least, CAST(max(char_len) FILTER (i = least(floor(n * 0.5), n - 1)) AS INTEGER) AS p50,
    CAST(max(char_len) FILTER (i = least(floor(n * 0.9), n - 1)) AS INTEGER) AS p90, CAST(max(char_len) AS INTEGER) AS greatest FROM p GROUP BY source_id""")
def c14(spark, sf_dir):
    return chunking.length_report(corpus.chunks(_docs(spark, sf_dir)))


@query("C14_ingest_report", f"WITH {_CH} SELECT source_id, CASE WHEN doc_id % 4 = 0 THEN 'rules' ELSE 'build' END AS category, count(*) AS chunks, count(*) FILTER (char_len > 3600) AS split_parts FROM chunks GROUP BY ALL")
def c14_ingest(spark, sf_dir):
    made = corpus.chunks(_docs(spark, sf_dir)).withColumn("category", F.when(F.col("doc_id") % 4 == 0, "rules").otherwise("build"))
    return chunking.ingest_report(made.withColumn("part_count", F.when(F.col("char_len") > 3600, 2).otherwise(1)))


# publication


def _snapshots(spark, sf_dir):
    """Two snapshots of complete chunk rows: of ten documents one is new, one goes, and of others the text, the licence, the heading path or the mode changes."""
    docs, n = _docs(spark, sf_dir), F.col("doc_id")
    registry = corpus.source_registry(docs).select("source_id", "source_name", "can_excerpt", F.col("mode").alias("excerpt_mode"))
    whole = corpus.chunks(docs).join(F.broadcast(registry), "source_id").withColumns({  # a row a source
        "doc_path": F.concat(F.lit("docs/"), n.cast("string")), "heading_path": F.col("section_title"), "anchor": F.lit(""), "category": F.lit("build"), "license": F.lit("BSD"), "part": F.lit(0), "part_count": F.lit(1),
    })
    text = F.when(n % 10 == 5, F.concat("text", F.lit(" amended"))).otherwise(F.col("text"))
    after = whole.where("doc_id % 10 <> 7").withColumns({
        "text": text, "license": F.when(n % 10 == 1, "MIT").otherwise("BSD"), "heading_path": F.when(n % 10 == 2, F.lit("moved")).otherwise(F.col("heading_path")),
        "excerpt_mode": F.when(n % 10 == 4, "withheld").otherwise(F.col("excerpt_mode")),
    })
    after = after.withColumn("content_hash", F.sha2("text", 256)).withColumn("char_len", F.length("text"))
    return whole.where("doc_id % 10 <> 3"), after


def _both_tables(spark, sf_dir):
    """Snapshots with their source tables: sources by number are new, gone, under another licence, or of another priority."""
    before, after = _snapshots(spark, sf_dir)
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    sources = corpus.source_registry(_docs(spark, sf_dir)).drop("mode").withColumns({"license": F.lit("BSD"), "attribution": F.lit(None).cast("string"), "updated_at": F.lit("2024-01-01")})
    new = sources.where(number % 5 != 4).withColumns({
        "license": F.when(number % 5 == 1, "MIT").otherwise("BSD"), "attribution": F.when(number % 5 == 2, "").otherwise(F.col("attribution")), "updated_at": F.lit("2024-06-01"),
    })
    return publication.Snapshot(sources.where(number % 5 != 3), before), publication.Snapshot(new, after)


_SNAP = f"""{_CH}, before AS (SELECT * FROM chunks WHERE doc_id % 10 <> 3), amended AS (
  SELECT * REPLACE (CASE WHEN doc_id % 10 = 5 THEN text || ' amended' ELSE text END AS text) FROM chunks WHERE doc_id % 10 <> 7),
after AS (SELECT * REPLACE (sha256(text) AS content_hash, length(text) AS char_len) FROM amended),
hashes AS (SELECT coalesce(b.chunk_id, a.chunk_id) AS chunk_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.section_title, CASE WHEN b.chunk_id IS NULL THEN 'added' WHEN a.chunk_id IS NULL THEN 'removed'
  WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM before b FULL JOIN after a ON a.chunk_id = b.chunk_id),
changes AS (SELECT chunk_id, CASE WHEN change = 'unchanged' AND (doc_id % 10 IN (1, 4) OR doc_id % 10 = 2 AND section_title <> 'moved') THEN 'changed' ELSE change END AS change FROM hashes)"""
_SOURCE_CHANGES_SQL = f"""{_REG}, source_changes AS (SELECT source_id, CASE n % 5 WHEN 3 THEN 'added' WHEN 4 THEN 'removed' WHEN 1 THEN 'changed' WHEN 2 THEN 'changed' ELSE 'unchanged' END AS change
  FROM (SELECT source_id, CAST(regexp_extract(source_id, '(\\d+)$', 1) AS INTEGER) AS n FROM registry))"""


_LINK_SQL = f"printf('{publication.LINK_TEXT}', source_name, section_title, source_name, page_title)"
_BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in publication.BLANKS)


@query("P1_chunk_violations", f"""WITH {_CH}, {_REG}, made AS (SELECT c.* REPLACE (concat_ws(':', source_id, substr(sha256('docs/' || doc_id || '#root:1'), 1, 16)) AS chunk_id), mode, r.can_excerpt AS source_allows,
    r.source_name AS registered, CASE WHEN doc_id % 23 = 0 THEN r.source_name || '?' ELSE r.source_name END AS source_name, doc_id % 5 = 0 AS can_excerpt, CASE WHEN doc_id % 7 = 0 THEN 'full' ELSE mode END AS excerpt_mode,
    CASE WHEN doc_id % 29 = 0 THEN 'MIT' ELSE 'BSD' END AS license, 0 AS part, CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 1 END AS part_count FROM chunks c JOIN registry r USING (source_id)),
  told AS (SELECT * REPLACE (CASE WHEN mode = 'link' AND doc_id % 2 = 1 THEN {_LINK_SQL} ELSE text END AS text) FROM made),
  spoiled AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 THEN sha256('x') ELSE sha256(text) END AS content_hash, length(text) AS char_len) FROM told),
  judged AS (SELECT chunk_id, [
    CASE WHEN NOT starts_with(chunk_id, source_id || ':') OR strlen(chunk_id) > 64 THEN 'id shape' END, CASE WHEN mode IS NULL THEN 'unregistered source' END,
    CASE WHEN ltrim(text, {_BLANKS_SQL}) = '' THEN 'empty text' END, CASE WHEN sha256(text) <> content_hash THEN 'hash' END, CASE WHEN length(text) <> char_len THEN 'length' END,
    CASE WHEN NOT starts_with(source_url, 'https://') THEN 'url' END, CASE WHEN source_name IS DISTINCT FROM registered THEN 'name' END, CASE WHEN license IS DISTINCT FROM 'BSD' THEN 'license' END,
    CASE WHEN can_excerpt AND NOT source_allows THEN 'excerpt escalation' END, CASE WHEN mode = 'summarize' AND (can_excerpt OR excerpt_mode <> 'summarize') THEN 'restricted policy' END,
    CASE WHEN (excerpt_mode = 'full') <> can_excerpt THEN 'excerpt mode' END, CASE WHEN excerpt_mode NOT IN ('full', 'summarize', 'link') THEN 'unknown mode' END,
    CASE WHEN mode = 'link' AND (can_excerpt OR excerpt_mode <> 'link' OR text <> {_LINK_SQL}) THEN 'link-only body' END,
    CASE WHEN ordinal IS NULL OR ordinal < 0 THEN 'ordinal' END, CASE WHEN part IS NULL OR part < 0 THEN 'part' END, CASE WHEN part_count IS NULL OR part_count < 1 THEN 'part count' END] AS problems FROM spoiled),
  counted AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS copies FROM judged)
  SELECT * FROM (SELECT chunk_id, unnest(list_append(problems, CASE WHEN copies > 1 THEN 'duplicate id' END)) AS problem FROM counted) WHERE problem IS NOT NULL""")
def p1(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    registry = corpus.source_registry(docs).withColumn("license", F.lit("BSD"))
    n = F.col("doc_id")
    made = corpus.chunks(docs).join(registry.select("source_id", "mode", F.col("source_name").alias("registered")), "source_id")
    name = F.when(n % 23 == 0, F.concat("registered", F.lit("?"))).otherwise(F.col("registered"))
    allowed = made.select(
        "*", (n % 5 == 0).alias("can_excerpt"), F.when(n % 7 == 0, "full").otherwise(F.col("mode")).alias("excerpt_mode"), name.alias("source_name"),
        F.when(n % 29 == 0, "MIT").otherwise("BSD").alias("license"), F.col("section_title").alias("heading_path"), F.lit(0).alias("part"), F.when(n % 31 == 0, 0).otherwise(1).alias("part_count"),
    )
    link = F.format_string(publication.LINK_TEXT, "source_name", "heading_path", "source_name", "page_title")
    told = allowed.withColumn("text", F.when((F.col("mode") == "link") & (n % 2 == 1), link).otherwise(F.col("text")))
    hashed = told.withColumn("content_hash", F.sha2("text", 256)).withColumn("char_len", F.length("text"))
    spoiled = hashed.withColumn("content_hash", F.when(n % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("content_hash")))
    return publication.chunk_violations(spoiled, registry)


def _print_sql(columns: list[str]) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || '=' || {c}, '~')" for c in columns) + ")"


_COMPLETE_SQL = f"""{_CH}, {_REG}, complete AS (SELECT c.*, source_name, can_excerpt, mode AS excerpt_mode, 'docs/' || doc_id AS doc_path, section_title AS heading_path, '' AS anchor, 'build' AS category, 'BSD' AS license, 0 AS part, 1 AS part_count
  FROM chunks c JOIN registry USING (source_id) WHERE doc_id % 10 <> 3)"""


@query("P2_fingerprint", f"WITH {_COMPLETE_SQL} SELECT chunk_id, {_print_sql(publication.CHUNK_FIELDS)} AS fingerprint FROM complete")
def p2(spark, sf_dir):
    return _snapshots(spark, sf_dir)[0].select("chunk_id", publication.fingerprint(publication.CHUNK_FIELDS).alias("fingerprint"))


@query("P3_delta", f"WITH {_SNAP} SELECT * FROM changes")
def p3(spark, sf_dir):
    return publication.delta(*_snapshots(spark, sf_dir))


@query("P3_corpus_delta", f"WITH {_SNAP}, {_SOURCE_CHANGES_SQL} SELECT 'chunks' AS part, chunk_id AS id, change FROM changes UNION ALL SELECT 'sources', source_id, change FROM source_changes")
def p3_both(spark, sf_dir):
    return publication.corpus_delta(*_both_tables(spark, sf_dir))


@query("P4_rollback", f"WITH {_SNAP} SELECT chunk_id, CASE change WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE change END AS change FROM changes")
def p4(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return publication.delta(after, before)


@query("P5_apply_delta", f"""WITH {_SNAP}, {_REG} SELECT chunk_id, content_hash, CASE WHEN doc_id % 10 = 1 THEN 'MIT' ELSE 'BSD' END AS license, CASE WHEN doc_id % 10 = 2 THEN 'moved' ELSE section_title END AS heading_path,
  CASE WHEN doc_id % 10 = 4 THEN 'withheld' ELSE mode END AS excerpt_mode FROM after JOIN registry USING (source_id)""")
def p5(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return publication.apply_delta(before, after, publication.delta(before, after)).select("chunk_id", "content_hash", "license", "heading_path", "excerpt_mode")


@query("P5_sources", f"""WITH {_REG}, numbered AS (SELECT *, CAST(regexp_extract(source_id, '(\\d+)$', 1) AS INTEGER) AS n FROM registry)
  SELECT source_id, source_name, CASE WHEN n % 5 = 1 THEN 'MIT' ELSE 'BSD' END AS license, CASE WHEN n % 5 = 2 THEN '' END AS attribution, CASE WHEN n % 5 = 0 THEN '2024-01-01' ELSE '2024-06-01' END AS updated_at FROM numbered WHERE n % 5 <> 4""")
def p5_sources(spark, sf_dir):
    """A source of which nothing but the time of its update differs keeps its old row."""
    before, after = _both_tables(spark, sf_dir)
    made = publication.apply_corpus_delta(before, after, publication.corpus_delta(before, after))
    return made.sources.select("source_id", "source_name", "license", "attribution", "updated_at")


@query("P6_coverage_loss", f"""WITH {_CH}, b AS (SELECT source_id, count(*) AS before FROM chunks GROUP BY ALL), a AS (SELECT source_id, count(*) AS after FROM chunks WHERE char_len > 1000 GROUP BY ALL),
  j AS (SELECT source_id, before, coalesce(after, 0) AS after FROM b LEFT JOIN a USING (source_id)), w AS (SELECT CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after FROM j)
  SELECT * FROM j WHERE after < before * 0.8 UNION ALL SELECT NULL, before, after FROM w WHERE after < floor(before * 0.8)""")
def p6(spark, sf_dir):
    whole = corpus.chunks(_docs(spark, sf_dir))
    return publication.coverage_loss(whole, whole.where("char_len > 1000"))


_EPOCH_SQL = """l AS (SELECT source_id, sha256('=' || chunk_id || '|=' || content_hash || '|=' || source_url || '|=' || (doc_id % 3 = 0) || '|=' || CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'link' END || '|~') AS line FROM chunks),
  k AS (SELECT source_id, substr(line, 1, 3) AS head, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY ALL), s AS (SELECT source_id, sha256(string_agg(h, chr(10) ORDER BY head)) AS h FROM k GROUP BY source_id),
  e AS (SELECT substr(sha256(string_agg(h, chr(10) ORDER BY source_id)), 1, 16) AS epoch FROM s)"""


def _published(spark, sf_dir):
    open_ = F.col("doc_id") % 3 == 0
    return corpus.chunks(_docs(spark, sf_dir)).withColumn("can_excerpt", open_).withColumn("excerpt_mode", F.when(open_, "full").otherwise("link")).withColumn("license", F.lit(None).cast("string"))


@query("P7_manifest", f"WITH {_CH}, {_EPOCH_SQL} SELECT source_id, count(*) AS sections, CAST(sum(char_len) AS BIGINT) AS chars, epoch FROM chunks, e GROUP BY ALL")
def p7(spark, sf_dir):
    return publication.manifest(_published(spark, sf_dir))


@query("P7_manifest_mismatches", f"""WITH {_CH}, b AS (SELECT source_id, count(*) AS n FROM chunks GROUP BY ALL), a AS (SELECT source_id, count(*) AS n FROM chunks WHERE doc_id % 10 <> 7 GROUP BY ALL)
  SELECT coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN a.n IS NULL THEN 'no chunks' WHEN a.n <> b.n THEN 'sections' ELSE 'epoch' END AS problem FROM b FULL JOIN a ON a.source_id = b.source_id""")
def p7_mismatches(spark, sf_dir):
    whole = _published(spark, sf_dir)
    return publication.manifest_mismatches(publication.manifest(whole), whole.where("doc_id % 10 <> 7"))


@query("P8_epoch", f"WITH {_CH}, {_EPOCH_SQL} SELECT epoch FROM e")
def p8(spark, sf_dir):
    return publication.epoch(_published(spark, sf_dir))


@query("P9_summary", f"""WITH {_SNAP}, {_SOURCE_CHANGES_SQL}, every AS (SELECT 'chunks' AS part, change FROM changes UNION ALL SELECT 'sources', change FROM source_changes)
  SELECT part, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM every GROUP BY part""")
def p9(spark, sf_dir):
    return publication.publication_summary(publication.corpus_delta(*_both_tables(spark, sf_dir)))


@query("P10_restore_check", f"""WITH {_SNAP} SELECT chunk_id, CASE change WHEN 'added' THEN 'extra' WHEN 'removed' THEN 'missing' ELSE 'hash' END AS problem FROM hashes WHERE change <> 'unchanged'""")
def p10(spark, sf_dir):
    return publication.restore_mismatches(*_snapshots(spark, sf_dir))


@query("V1_dirty_chunks", f"WITH {_SNAP} SELECT chunk_id FROM after WHERE (chunk_id, content_hash) NOT IN (SELECT (chunk_id, content_hash) FROM before WHERE doc_id % 2 = 0)")
def v1(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    stored = before.select("chunk_id", "content_hash", F.when(F.col("doc_id") % 2 == 0, 64).otherwise(32).alias("dim"), F.lit("hashed").alias("model"))
    return vectors.dirty_chunks(after, stored, 64, "hashed").select("chunk_id")


@query("V3_reassembled", f"WITH {_SNAP} SELECT chunk_id, content_hash, CAST(CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 5 THEN 2 ELSE 1 END AS DOUBLE) AS first FROM after")
def v3(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    vector = lambda x: F.array(F.lit(x), F.lit(0.0)).alias("vector")
    fresh = after.where("doc_id % 10 = 5").select("chunk_id", "content_hash", vector(2.0))
    kept, missing = vectors.reassemble(after, before.select("chunk_id", "content_hash", vector(1.0)), fresh)
    lacking = missing.join(after.select("chunk_id", "content_hash"), "chunk_id").withColumn("first", F.lit(None).cast("double"))
    return kept.select("chunk_id", "content_hash", F.col("vector")[0].alias("first")).unionByName(lacking)


@query("V7_vector_violations", """WITH v AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * CASE WHEN vec_id % 13 = 0 THEN 4 ELSE 1 END AS n2 FROM embeddings WHERE vec_id % 17 <> 0)
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'missing' AS problem FROM embeddings WHERE vec_id % 17 = 0 UNION ALL SELECT CAST(vec_id AS VARCHAR), 'norm' FROM v WHERE abs(n2 - 1) > 0.02
  UNION ALL SELECT CAST(vec_id AS VARCHAR), 'stale' FROM v WHERE vec_id % 19 = 0""")
def v7(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 13 == 0, 2.0).otherwise(1.0))
    stored = rows.where("vec_id % 17 <> 0").select(
        "chunk_id", scaled.alias("vector"), F.when(F.col("vec_id") % 19 == 0, "old").otherwise("h").alias("content_hash"), F.lit("m").alias("model")
    )
    return vectors.vector_violations(rows.select("chunk_id", F.lit("h").alias("content_hash")), stored, 64, "m")
