"""Raw HTML pages read with regular expressions: articles, headings, links, titles, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtable.operators.publication import LINK_TEXT

_HIDDEN = "|".join(rf"<{tag}[^>]*>.*?</{tag}>" for tag in ("script", "style", "nav", "header", "footer"))


def decode_references(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def articles(pages: DataFrame, least: int = 120, most: int | None = None) -> DataFrame:
    """The text of a page's article, or main element, in paragraphs; cut to ``most`` characters where that is given."""
    article = F.regexp_extract("html", r"(?is)<article[^>]*>(.*)</article>", 1)
    body = F.when(article != "", article).otherwise(F.regexp_extract("html", r"(?is)<main[^>]*>(.*)</main>", 1))
    text = F.regexp_replace(body, f"(?is){_HIDDEN}", "")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|h[1-6]|li|section)>|<br */?>", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\s*\n\s*\n\s*", "\n\n")
    whole = F.regexp_replace(decode_references(text), r"^[ \n]+|[ \n]+$", "")
    found = pages.select("page_id", "url", whole.alias("text")).where(F.length("text") >= least)
    return found if most is None else found.withColumn("text", F.substring("text", 1, most))


def headings(pages: DataFrame) -> DataFrame:
    """S3: the headings of pages in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("place", "title"))


def plain_text(markup: Column) -> Column:
    """Markup without tags, references decoded, white space as single blanks."""
    return F.trim(F.regexp_replace(decode_references(F.regexp_replace(markup, "<[^>]*>", " ")), r"\s+", " "))


_SILENT = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}>" for tag in ("script", "style", "nav", "footer"))


def page_sections(pages: DataFrame) -> DataFrame:
    """S3: (page_id, ord, level, title, anchor, body): pages cut at their headings; pages without a heading are left out.

    The body is the text up to the next heading of any level, block by block; the anchor is the heading's id.
    """
    text = F.regexp_replace("html", f"(?is){_SILENT}|<!--.*?-->", "")
    parts = F.slice(F.split(text, r"(?i)(?=<h[1-6][\s>])"), F.lit(2), F.lit(1 << 20))
    rows = pages.select("page_id", F.posexplode(parts).alias("ord", "part"))
    pattern = r"(?is)^<h([1-6])([^>]*)>(.*?)</h[1-6]>(.*)$"
    part = lambda i: F.regexp_extract("part", pattern, i)
    blocks = F.split(F.regexp_replace(part(4), r"(?i)</(?:p|div|li|section|article)>|<br */?>|<p[\s>]", "\u0001"), "\u0001")
    body = F.array_join(F.filter(F.transform(blocks, lambda b: plain_text(F.regexp_replace(b, "^[^<>]*>", ""))), lambda b: b != ""), "\n\n")
    return rows.where(part(1) != "").select(
        "page_id", "ord", part(1).cast("int").alias("level"), plain_text(part(3)).alias("title"), F.regexp_extract(part(2), r'(?i)\bid="([^"]*)"', 1).alias("anchor"), body.alias("body")
    )


def path_filter(
    pages: DataFrame, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "css", "js"), folders: tuple[str, ...] = ("_static", "_templates", "assets", "images", "_build"),
    skip: tuple[str, ...] = (), only: str | None = None, names: str | None = None,
) -> DataFrame:
    """Pages whose URL has none of the extensions, folders and ``skip`` patterns; ``only`` is a pattern that it
    must have, ``names`` one that its last part must not have."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    kept = pages.where(~path.rlike(rf"(?i)\.({'|'.join(extensions)})$") & ~path.rlike(f"/({'|'.join(folders)})/"))
    for pattern in skip:
        kept = kept.where(~F.col("url").rlike(pattern))
    if only is not None:
        kept = kept.where(F.col("url").rlike(only))
    return kept if names is None else kept.where(~F.regexp_extract(path, r"([^/]*)$", 1).rlike(names))


def sitemap(files: DataFrame) -> DataFrame:
    """(page_id, place, loc, is_index): the locations that a sitemap lists; those of an index are sitemaps themselves."""
    locations = F.regexp_extract_all("html", F.lit("<loc>([^<]+)</loc>"), F.lit(1))
    return files.select("page_id", F.posexplode(locations).alias("place", "loc"), F.col("html").rlike("(?i)<sitemapindex").alias("is_index")).withColumn("loc", F.trim("loc"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, title) of all links."""
    pattern = F.lit(r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("title"))
    return pages.select("page_id", F.posexplode(pairs).alias("place", "link")).select("page_id", "place", F.col("link.href").alias("href"), F.col("link.title").alias("title"))


def first_titles(found: DataFrame) -> DataFrame:
    """The first title that each URL is linked by."""
    return found.groupBy("href").agg(F.min_by("title", F.struct("page_id", "place")).alias("title"), F.count("*").alias("links"))


def titles(pages: DataFrame) -> DataFrame:
    """Page titles without the site's suffix."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select("page_id", F.trim(F.regexp_replace(title, " [|-] [^|-]*$", "")).alias("title"))


def outline(rows: DataFrame) -> DataFrame:
    """Indented lines to (doc_id, ord, level, title); two blanks are one level."""
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where(F.trim("line") != "")
    indent = F.length(F.regexp_extract("line", "^( *)", 1))
    return lines.select("doc_id", "ord", (F.floor(indent / 2) + 1).cast("int").alias("level"), F.trim(F.regexp_replace("line", r"^\s*[-*]\s*", "")).alias("title"))


def _board(pages: DataFrame) -> DataFrame:
    """Answered questions in the JSON that a public board page embeds; one row each.

    Rows that repeat a page's number are all rejected: :func:`board_rejects` names them.
    """
    schema = (
        "board STRUCT<name: STRING, config: STRUCT<isPublic: BOOLEAN>>, "
        "questions ARRAY<STRUCT<number: INT, questionId: STRING, status: STRING, title: STRING, content: STRING, "
        "answer: STRUCT<questionId: STRING, content: STRING, modifiedAt: BIGINT>>>"
    )
    data = F.from_json(F.regexp_extract("html", r"(?s)<script[^>]*application/json[^>]*>(.*?)</script>", 1), schema)
    rows = pages.select("page_id", data.alias("d")).where("d.board.config.isPublic").select("page_id", F.explode("d.questions").alias("q"))
    answered = rows.where("q.status = 'ANSWERED' AND q.answer.questionId = q.questionId")
    return answered.withColumn("copies", F.count("*").over(Window.partitionBy("page_id", "q.number"))).select(
        "page_id", "q.number", "q.title", "q.content", F.col("q.answer.content").alias("answer"),
        F.timestamp_millis("q.answer.modifiedAt").alias("modified_at"),
        "copies",
    )


def board_answers(pages: DataFrame) -> DataFrame:
    """The answered questions whose number a page has once."""
    return _board(pages).where("copies = 1").drop("copies")


def board_rejects(pages: DataFrame) -> DataFrame:
    """(page_id, number, copies) of numbers that a page repeats."""
    return _board(pages).where("copies > 1").select("page_id", "number", "copies").distinct()


def link_chunks(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of link-only sources say where the page is and never what it says."""
    linked = chunks.join(registry.where("mode = 'link'"), "source_id")
    text = F.format_string(
        LINK_TEXT,
        "source_name", "section_title", "source_name", "page_title",
    )
    return linked.withColumn("text", text)


def symbols(docs: DataFrame) -> DataFrame:
    """Distinct identifiers with their kind by case."""
    names = docs.where("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,})(?![A-Za-z0-9_])"), F.lit(1))).alias("name")).distinct()
    kind = F.when(F.col("name").rlike("^[A-Z][A-Z0-9_]+$"), "constant").when(F.col("name").rlike("^[A-Z][A-Za-z0-9]*$"), "type").otherwise("method")
    return names.withColumn("kind", kind)


def missing_sources(registry: DataFrame, chunks: DataFrame, minimum: int = 1) -> DataFrame:
    """(source_id, problem): registered sources without any chunk, and a corpus of fewer than ``minimum`` chunks (no source_id)."""
    lacking = registry.select("source_id").join(chunks.select("source_id"), "source_id", "left_anti").withColumn("problem", F.lit("no chunks"))
    whole = chunks.agg(F.count("*").alias("n")).where(F.col("n") < minimum)
    return lacking.unionByName(whole.select(F.lit(None).cast("string").alias("source_id"), F.lit("incomplete corpus").alias("problem")))


# What tells a licence comment, and kinds of sample files by the beginning of their names.
LICENCE = "Redistribution and use"
SAMPLE_KINDS = [("Concept", "concept"), ("Robot", "robot"), ("Sensor", "sensor")]


def code_chunks(files: DataFrame, most: int = 6_000, source: str = "SDK Samples", categories: DataFrame | None = None) -> DataFrame:
    """(name, kind, category, description, text) of code files (name, text).

    The licence comment goes, the first other block comment is the description, and code is kept up to ``most``
    characters, as the feature asks.  ``categories`` (name, category) overrides "programming".
    """
    comments = F.regexp_extract_all("text", F.lit(r"(?s)(/\*.*?\*/)"), F.lit(1))
    first = F.coalesce(F.get(F.filter(comments, lambda c: ~c.rlike(f"(?i){LICENCE}")), 0), F.lit(""))
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, r"^/\*+|\*+/$", ""), r"(?m)^[ \t]*\*[ \t]?", ""), r"(?m)[ \t]+$", "")
    description = F.regexp_replace(lines, r"^\s+|\s+$", "")
    code = F.regexp_replace(F.regexp_replace("text", rf"(?s)^(.*?)/\*(?:(?!\*/).)*?{LICENCE}.*?\*/", "$1"), r"^\s+|\s+$", "")
    kind = F.lit("basic")
    for prefix, name in reversed(SAMPLE_KINDS):
        kind = F.when(F.col("name").startswith(prefix), name).otherwise(kind)
    made = files.select("name", kind.alias("kind"), description.alias("description"), F.substring(code, 1, most).alias("code"))
    text = F.format_string(f"# {source}\n## %s (official sample OpMode, %s)\n\n%s\n\n```java\n%s\n```", "name", "kind", "description", "code")
    if categories is None:
        return made.select("name", "kind", F.lit("programming").alias("category"), "description", text.alias("text"))
    return made.join(categories, "name", "left").select("name", "kind", F.coalesce("category", F.lit("programming")).alias("category"), "description", text.alias("text"))


def api_chunks(pages: DataFrame, source: str = "SDK API", most: int = 1_200, methods: int = 40) -> DataFrame:
    """(page_id, package, name, text) of API reference pages (page_id, path, html).

    The package is the path's folders after the first; pages with neither a description of 40 characters nor
    methods are left out.
    """
    block = F.regexp_extract("html", r'(?s)(<section class="class-description".*?</section>)', 1)
    block = F.when(block != "", block).otherwise(F.regexp_extract("html", r'(?s)<div class="block">(.*?)</div>', 1))
    pattern = F.lit(r'(?s)<code><a[^>]*>(\w+)</a>\(([^)]*)\)</code>.{0,400}?<div class="block">(.{0,220}?)</div>')
    found = F.arrays_zip(*[F.regexp_extract_all("html", pattern, F.lit(i)).alias(n) for i, n in ((1, "m"), (2, "a"), (3, "d"))])
    listed = F.transform(F.slice(found, 1, methods), lambda x: F.concat(F.lit("- "), x["m"], F.lit("("), plain_text(x["a"]), F.lit(") — "), plain_text(x["d"])))
    folders = F.split(F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1), "/")
    package = F.array_join(F.slice(folders, F.lit(2), F.greatest(F.size(folders) - 1, F.lit(0))), ".")
    rows = pages.select(
        "page_id", package.alias("package"), F.regexp_extract("path", r"([^/]*?)(?:\.html)?$", 1).alias("name"), F.substring(plain_text(block), 1, most).alias("description"), listed.alias("methods")
    ).where((F.length("description") >= 40) | (F.size("methods") > 0))
    tail = F.when(F.size("methods") > 0, F.concat(F.lit("Methods:\n"), F.array_join("methods", "\n"))).otherwise("")
    return rows.select("page_id", "package", "name", F.concat(F.format_string(f"# {source}\n## %s.%s\n\n%s\n\n", "package", "name", "description"), tail).alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as NDJSON, a folder per source; writing again replaces the sources that are written and keeps others."""
    chunks.write.mode("overwrite").partitionBy("source_id").option("partitionOverwriteMode", "dynamic").json(path)


def stage_publication(forward: DataFrame, rollback: DataFrame, path: str) -> DataFrame:
    """The changes of a publication and of its rollback as Parquet, with a checksum of each beside them.

    Returns (artefact, rows, checksum): rows are hashed one by one and their hashes summed, so the checksum
    does not depend on how rows lie in files.
    """
    spark, out = forward.sparkSession, None
    for name, part in (("forward", forward), ("rollback", rollback)):
        part.write.mode("overwrite").parquet(f"{path}/{name}")
        stored = spark.read.schema(part.schema).parquet(f"{path}/{name}")
        line = F.sha2(F.to_json(F.struct(*stored.columns), {"ignoreNullFields": "false"}), 256)
        words = [F.sum(F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
        mark = stored.agg(F.lit(name).alias("artefact"), F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *[F.coalesce(w, F.lit("0")) for w in words]), 256).alias("checksum"))
        out = mark if out is None else out.unionByName(mark)
    out.coalesce(1).write.mode("overwrite").json(f"{path}/checksums")
    return out
