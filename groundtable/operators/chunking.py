"""Sections of pages turned into chunks: heading paths, merging, splitting, rendering, identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChunkParams:
    """Sizes in characters at which units are merged, split or dropped."""

    min_chars: int = 240
    merge_max: int = 2200
    max_chars: int = 3600
    split_target: int = 2400
    rule_target: int = 2600
    keep_chars: int = 80
    levels: int = 6


DEFAULTS = ChunkParams()


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def heading_paths(sections: DataFrame, levels: int = DEFAULTS.levels) -> DataFrame:
    """Adds ``heading_path``, the titles of the open ancestors and the section's own.

    The last section of each level so far is an ancestor if it came after the last ones of all
    levels above it.
    """
    seen = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {level: F.max(F.when(F.col("level") == level, F.struct("ord", "title"))).over(seen) for level in range(1, levels)}
    marked = sections.withColumns({f"_l{level}": c for level, c in last.items()})
    parts, above = [], F.lit(-1)
    for level in range(1, levels):
        place = F.coalesce(F.col(f"_l{level}.ord"), F.lit(-1))
        parts.append(F.when((F.col("level") > level) & (place > above), F.col(f"_l{level}.title")))
        above = F.greatest(above, place)
    path = F.array_join(F.array_compact(F.array(*parts, F.col("title"))), " > ")
    return marked.withColumn("heading_path", path).drop(*[f"_l{level}" for level in range(1, levels)])


def merge_thin(sections: DataFrame, params: ChunkParams = DEFAULTS) -> DataFrame:
    """A section joins the one before while that is thin and both fit; the first one's place is kept.

    The test looks at the length merged so far, so it is a fold over a document's ordered sections.  The
    fold sees lengths only and says at which sections a unit begins; bodies are joined by plain grouping.
    """
    placed = sections.select("doc_id", "ord", strip(F.col("body")).alias("body"))
    sizes = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.length("body").alias("n")))).alias("units"))
    start = F.struct(F.lit("").alias("starts"), F.lit(-1).alias("n"))

    def step(s: Column, u: Column) -> Column:
        joins = (s["n"] >= 0) & (s["n"] < params.min_chars) & (s["n"] + u["n"] < params.merge_max)
        longer = s["n"] + u["n"] + F.when((s["n"] > 0) & (u["n"] > 0), 2).otherwise(0)
        return F.struct(F.when(joins, s["starts"]).otherwise(F.concat_ws(" ", s["starts"], u["ord"].cast("string"))).alias("starts"), F.when(joins, longer).otherwise(u["n"]).alias("n"))

    begun = sizes.select("doc_id", F.explode(F.split(F.trim(F.aggregate("units", start, step)["starts"]), " ")).alias("ord")).select("doc_id", F.col("ord").cast("int").alias("ord"), F.lit(True).alias("begins"))
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unit = placed.join(begun, ["doc_id", "ord"], "left").withColumn("unit", F.last(F.when(F.col("begins"), F.col("ord")), ignorenulls=True).over(order))
    lines = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("ord", "body"))))
    return unit.groupBy("doc_id", F.col("unit").alias("ord")).agg(F.array_join(F.transform(lines, lambda x: x["body"]), "\n\n").alias("body"))


def keep_units(units: DataFrame, least: int = DEFAULTS.keep_chars) -> DataFrame:
    """Units with enough text."""
    return units.where(F.length(F.trim(F.regexp_replace("body", r"\s+", " "))) >= least)


def atoms(body: Column) -> Column:
    """C4: paragraphs between blank lines; a fenced code block is one atom whatever is in it."""
    fenced = F.split(body, r"(?m)^```")  # odd parts lie inside fences

    def part(p: Column, i: Column) -> Column:
        prose = F.transform(F.split(p, r"\n[ \t]*(?:\n[ \t]*)+"), strip)
        return F.when(i % 2 == 1, F.array(F.concat(F.lit("```"), p, F.lit("```")))).otherwise(F.filter(prose, lambda a: F.regexp_replace(a, r"\s", "") != ""))

    return F.flatten(F.transform(fenced, part))


def split_oversize(body: Column, params: ChunkParams = DEFAULTS) -> Column:
    """A body beyond the ceiling is packed from its atoms; an atom is never cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("len"))

    def step(s: Column, a: Column) -> Column:
        full = (s["len"] > 0) & (s["len"] + F.length(a) + 2 > params.split_target)
        fresh = F.struct(F.concat(s["done"], F.array(s["buf"])).alias("done"), a.alias("buf"), (F.length(a) + 2).alias("len"))
        more = F.struct(
            s["done"].alias("done"), F.when(s["buf"] == "", a).otherwise(F.concat_ws("\n\n", s["buf"], a)).alias("buf"), (s["len"] + F.length(a) + 2).alias("len")
        )
        return F.when(full, fresh).otherwise(more)

    packed = F.aggregate(atoms(body), start, step, lambda s: F.when(s["buf"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["buf"]))))
    return F.when(F.length(body) <= params.max_chars, F.array(body)).otherwise(packed)


def _pack(pieces: Column, joint: str, target: int) -> Column:
    """Pieces joined in order up to ``target`` characters; a piece is never cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("len"))

    def step(s: Column, a: Column) -> Column:
        full = (s["len"] > 0) & (s["len"] + F.length(a) > target)
        size = F.length(a) + len(joint)
        fresh = F.struct(F.concat(s["done"], F.array(s["buf"])).alias("done"), a.alias("buf"), size.alias("len"))
        buf = F.when(s["len"] == 0, a).otherwise(F.concat_ws(joint, s["buf"], a))
        return F.when(full, fresh).otherwise(F.struct(s["done"].alias("done"), buf.alias("buf"), (s["len"] + size).alias("len")))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["len"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["buf"]))))


def rule_units(body: Column, params: ChunkParams = DEFAULTS) -> Column:
    """A body with lines that begin with a rule code is cut there, any other at blank lines.

    A unit beyond the ceiling is packed anew from its lines; a line is never cut.
    """
    by_rule = F.split(body, r"\n(?=[A-Z]{1,2}\d{2,3}\s)")
    units = F.when(body.rlike(r"(?m)^[A-Z]{1,2}\d{2,3}\s"), by_rule).otherwise(F.split(body, r"\n\s*\n"))
    return F.flatten(F.transform(units, lambda u: F.when(F.length(u) <= params.max_chars, F.array(u)).otherwise(_pack(F.split(u, "\n"), "\n", params.rule_target))))


def rule_parts(body: Column, params: ChunkParams = DEFAULTS) -> Column:
    """Rule units packed to the target size, which makes a section's parts."""
    return _pack(rule_units(body, params), "\n\n", params.rule_target)


# Numbered headings, rows of a table of contents, and rule codes of a manual.
MANUAL_HEADING = r"^\s{0,6}(?:(\d{2}(?:\.\d{1,2}){0,2})\s+|(\d(?:\.\d{1,2}){0,2})\s{2,})([A-Z][^\n]{2,80}?)\s*$"
CONTENTS_ROW = r"\.{5,}\s*\d+\s*$"
RULE_CODE = r"\b([A-Z]{1,2}\d{2,3})\b"


def manual_sections(texts: DataFrame, least: int = 200, codes: int = 8) -> DataFrame:
    """A manual's text (doc_id, text) to numbered sections (doc_id, place, number, title, body).

    Rows of the table of contents are skipped, lines before the first heading belong to none, blank lines go,
    and sections with little text are left out.
    """
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", F.regexp_replace("raw", r"\s+$", ""))
    kept = lines.where(~F.col("raw").rlike(CONTENTS_ROW))
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = kept.withColumn("head", F.col("raw").rlike(MANUAL_HEADING)).withColumn("place", F.count_if("head").over(order)).where(F.col("place") > 0)
    part = lambda i: F.regexp_extract("raw", MANUAL_HEADING, i)
    number = F.when(part(1) != "", part(1)).otherwise(part(2))
    body = F.array_sort(F.collect_list(F.when(~F.col("head") & (F.trim("raw") != ""), F.struct("line", F.regexp_replace("raw", r"^\s{0,12}", "").alias("t")))))
    sections = marked.groupBy("doc_id", "place").agg(
        F.max(F.when(F.col("head"), number)).alias("number"), F.max(F.when(F.col("head"), F.regexp_replace(F.trim(part(3)), r"\s{2,}", " "))).alias("title"),
        strip(F.array_join(F.transform(body, lambda x: x["t"]), "\n")).alias("body"),
    )
    return sections.where(F.length("body") >= least)


def manual_chunks(sections: DataFrame, params: ChunkParams = DEFAULTS, codes: int = 8, name: str = "Competition Manual") -> DataFrame:
    """C7 with C6: sections to chunks (doc_path, heading_path, part, part_count, text); a chunk names the first rule codes in it."""
    packed = sections.withColumn("parts", rule_parts(F.col("body"), params)).withColumn("part_count", F.size("parts"))
    rows = packed.select("doc_id", "place", "number", "title", "part_count", F.posexplode("parts").alias("i", "part_text"))
    found = F.array_join(F.slice(F.array_distinct(F.regexp_extract_all("part_text", F.lit(RULE_CODE), F.lit(1))), 1, codes), ", ")
    several = F.col("part_count") > 1
    head = F.concat_ws(" ", "number", "title")
    return rows.select(
        "doc_id", "place", F.concat(F.lit("manual/"), "number", F.when(several, F.format_string("-%d", F.col("i") + 1)).otherwise("")).alias("doc_path"),
        F.concat(F.lit(f"{name} > "), head, F.when(found != "", F.concat(F.lit(" > "), found)).otherwise("")).alias("heading_path"),
        F.when(several, F.col("i") + 1).otherwise(0).alias("part"), "part_count",
        F.concat(F.lit(f"# {name}\n## "), head, F.when(found != "", F.concat(F.lit(" (rules "), found, F.lit(")"))).otherwise(""), F.lit("\n\n"), "part_text").alias("text"),
    )


# A word said twice at a title's end, and words that would dangle there.
DOUBLED = r"(?i)\b(\w[\w'-]*)(\s+\1)+\b\s*$"
DANGLING = "to of in on and or with for vs from at the a an into".split()


def tidy_title(title: Column) -> Column:
    """A last word said twice, or equal to the first, is dropped unless the rest would dangle."""
    once = F.trim(F.regexp_replace(title, DOUBLED, "$1"))
    words = F.split(once, r"\s+")
    dangles = F.lower(F.element_at(words, F.when(F.size(words) > 1, -2).otherwise(-1))).isin(*DANGLING)
    doubled = (F.size(words) > 2) & (F.lower(F.element_at(words, 1)) == F.lower(F.element_at(words, -1))) & ~dangles
    return F.when(doubled, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(once)


def anchor_id(title: Column) -> Column:
    """A heading's HTML id."""
    plain = F.translate(F.lower(title), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), "^[0-9]+-*", "")


def allocate_anchors(sections: DataFrame) -> DataFrame:
    """Ids of a document's headings, first come, first served.

    A heading's ``label`` (the column may be absent) gives its id if no heading before it has that id, else its
    title does on the same terms, else it takes the next of id1, id2, ... that is free.  Serial numbers go up
    through the document.  One fold over the document's headings carries the ids in use, the numbers that
    headings have by themselves, and the last serial number.
    """
    label = anchor_id(F.coalesce(F.col("label"), F.lit(""))) if "label" in sections.columns else F.lit("")
    heads = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", label.alias("label"), anchor_id(F.col("title")).alias("base")))).alias("heads"))
    strings, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    start = F.struct(strings.alias("used"), numbers.alias("taken"), F.lit(0).alias("serial"), strings.alias("anchors"))

    def step(s: Column, h: Column) -> Column:
        free = lambda c: (c != "") & ~F.array_contains(s["used"], c)
        own = F.when(free(h["label"]), h["label"]).when(free(h["base"]), h["base"])
        next_serial = F.aggregate(F.array_sort(s["taken"]), s["serial"] + 1, lambda n, t: F.when(t == n, n + 1).otherwise(n))
        anchor = F.coalesce(own, F.concat(F.lit("id"), next_serial.cast("string")))
        number = F.when(own.rlike("^id[1-9][0-9]{0,8}$"), F.array(F.substring(own, 3, 9).cast("int"))).otherwise(numbers)
        return F.struct(
            F.concat(s["used"], F.array(anchor)).alias("used"), F.concat(s["taken"], number).alias("taken"),
            F.when(own.isNull(), next_serial).otherwise(s["serial"]).alias("serial"), F.concat(s["anchors"], F.array(anchor)).alias("anchors"),
        )

    found = heads.select("doc_id", "heads", F.aggregate("heads", start, step, lambda s: s["anchors"]).alias("anchors"))
    given = found.select("doc_id", F.explode(F.arrays_zip(F.col("heads.ord").alias("ord"), F.col("anchors").alias("anchor"))).alias("h")).select("doc_id", "h.ord", "h.anchor")
    return sections.join(given, ["doc_id", "ord"])


# Title words by category, first match wins.
TITLE_CATEGORIES = [
    (r"onshape|solidworks|fusion ?360|\bcad\b|part ?studio|parametric|sketch|extrud|revolve|loft|fillet|chamfer|\bshell\b|\bdraft\b|\brib\b|mate ?connector|feature ?tree|assembl", "build"),
    (r"odometry|dead ?wheel|localiz|pose|road ?runner|pinpoint", "odometry"),
    (r"drivetrain|mecanum|tank drive|x-?drive|swerve|strafe", "drivetrains"),
    (r"intake|transfer|claw|turret|gripper", "intakes"),
    (r"motor|servo|sensor|wiring|battery|control hub|expansion hub|encoder|power", "electronics"),
    (r"opmode|java|kotlin|android studio|telemetry|pid|vision|apriltag|sdk|program", "programming"),
    (r"rule|inspection|award|notebook|portfolio|judg|competition|manual", "rules"),
    (r"error|exception|stack ?trace|troubleshoot|crash", "errors"),
]


# Page paths by category, first match wins, before any title rule.
PATH_CATEGORIES = [
    (r"^common-mechanisms/drivetrains", "drivetrains"),
    (r"^common-mechanisms/dead-wheels", "odometry"),
    (r"^common-mechanisms/(active-intake|passive-intake|transfers|turrets)", "intakes"),
    (r"^common-mechanisms/", "build"),
    (r"^power-and-electronics", "electronics"),
    (r"^hardware-components", "electronics"),
    (r"^software/(concepts|adv-control-system)", "programming"),
    (r"^software/", "programming"),
    (r"^(awards|being-a-team|mission-statement)", "rules"),
    (r"^(custom-manufacturing|design-skills|robot-showcase|appendix)", "build"),
]


def category(
    title: Column, path: Column | None = None, rules: list[tuple[str, str]] = TITLE_CATEGORIES, path_rules: list[tuple[str, str]] = PATH_CATEGORIES, default: str = "build"
) -> Column:
    """C11: the first rule on the page's path that matches, else the first on its title."""
    found = F.when(F.lit(False), "")
    for pattern, name in path_rules if path is not None else []:
        found = found.when(path.rlike(pattern), name)
    for pattern, name in rules:
        found = found.when(title.rlike(f"(?i){pattern}"), name)
    return found.otherwise(default)


def rendered_chunks(units: DataFrame, params: ChunkParams = DEFAULTS) -> DataFrame:
    """(doc_id, ord, page_title, heading_path, body) to chunk texts with part numbers and ordinals.

    Where units have ``page_url`` and ``anchor``, chunks have the URL of their section.
    """
    pieces = units.withColumn("pieces", split_oversize(F.col("body"), params)).withColumn("part_count", F.size("pieces"))
    placed = {"page_url", "anchor"} <= set(units.columns)
    url = F.concat("page_url", F.when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit("#"), "anchor")).otherwise("")) if placed else F.lit(None).cast("string")
    parts = pieces.select("doc_id", "ord", "page_title", "heading_path", "part_count", url.alias("source_url"), F.posexplode("pieces").alias("i", "piece"))
    suffix = F.when(F.col("part_count") > 1, F.format_string(" (part %d of %d)", F.col("i") + 1, F.col("part_count"))).otherwise("")
    head = F.when(
        (F.col("heading_path") != "") & (F.col("heading_path") != F.col("page_title")), F.concat(F.lit("# "), "page_title", F.lit("\n## "), "heading_path")
    ).otherwise(F.concat(F.lit("# "), F.col("page_title")))
    order = Window.partitionBy("doc_id").orderBy("ord", "i")
    return parts.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("ordinal"),
        F.when(F.col("part_count") > 1, F.col("i") + 1).otherwise(0).alias("part"),
        "part_count",
        F.concat(head, suffix, F.lit("\n\n"), "piece").alias("text"),
        *(["source_url"] if placed else []),
    )


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids that occur more than once."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def licence_escalations(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks that allow more than their source does."""
    policy = registry.select("source_id", F.col("can_excerpt").alias("source_allows"))
    return chunks.join(policy, "source_id").where("can_excerpt AND NOT source_allows").select("chunk_id", "source_id")


def length_report(chunks: DataFrame) -> DataFrame:
    """C14: least, median, 90th and greatest length per source, by zero-based index floor(n * p).

    Chunks are counted per source and length first, so a source of any size is a few thousand rows when its
    running sums are read.
    """
    counts = chunks.groupBy("source_id", "char_len").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source_id")
    summed = counts.withColumn("until", F.sum("c").over(w.orderBy("char_len"))).withColumn("n", F.sum("c").over(w))
    index = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    at = lambda p: F.min(F.when(F.col("until") > index(p), F.col("char_len")))
    return summed.groupBy("source_id").agg(
        F.sum("c").alias("chunks"), F.min("char_len").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("char_len").alias("greatest")
    )


def ingest_report(chunks: DataFrame) -> DataFrame:
    """C14: chunks by source and category, and how many of them are parts of a split section (needs part_count)."""
    return chunks.groupBy("source_id", "category").agg(F.count("*").alias("chunks"), F.count_if(F.col("part_count") > 1).alias("split_parts"))
