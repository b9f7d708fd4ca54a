"""Corpus snapshots: validation, deltas, rollback, loss gates and manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the published tables whose change is published; the time of the last update is not among them.
CHUNK_FIELDS = (
    "chunk_id source_id source_name doc_path page_title section_title heading_path anchor source_url category license can_excerpt excerpt_mode text char_len ordinal part part_count content_hash"
).split()
SOURCE_FIELDS = "source_id source_name homepage license license_url attribution can_excerpt priority".split()


# Fixed value: all that a chunk of a link-only source may say.
LINK_TEXT = '# %s\n## %s\n\n%s documents this at "%s". The text of this page is not reproduced here; open the link to read it.'

# Fixed value: white space as the surveyed check trims it; a text of nothing else is empty.
BLANKS = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def chunk_violations(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(chunk_id, problem) for every broken rule of a chunk.

    Chunks and registry may have source_name and license, chunks heading_path, part, part_count and ordinal; rules
    on columns that are absent are not asked.
    """
    has = lambda *names: all(n in chunks.columns for n in names)
    shared = [c for c in ("source_name", "license") if has(c) and c in registry.columns]
    copies = chunks.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    policy = registry.select("source_id", F.col("can_excerpt").alias("source_allows"), F.col("mode").alias("source_mode"), *[F.col(c).alias(f"source_{c}") for c in shared])
    joined = chunks.join(copies, "chunk_id").join(policy, "source_id", "left")
    restricted = F.col("source_mode") == "summarize"
    linked = F.col("source_mode") == "link"
    rules = [
        F.when(F.col("copies") > 1, "duplicate id"),
        F.when(~F.col("chunk_id").startswith(F.concat(F.col("source_id"), F.lit(":"))) | (F.octet_length("chunk_id") > 64), "id shape"),
        F.when(F.col("source_mode").isNull(), "unregistered source"),
        F.when(F.ltrim("text", F.lit(BLANKS)) == "", "empty text"),
        F.when(F.sha2("text", 256) != F.col("content_hash"), "hash"),
        F.when(F.length("text") != F.col("char_len"), "length"),
        F.when(~F.col("source_url").rlike("^https://"), "url"),
        *[F.when(~F.col(c).eqNullSafe(F.col(f"source_{c}")), c.replace("source_", "")) for c in shared],
        F.when(F.col("can_excerpt") & ~F.col("source_allows"), "excerpt escalation"),
        F.when(restricted & (F.col("can_excerpt") | (F.col("excerpt_mode") != "summarize")), "restricted policy"),
        F.when((F.col("excerpt_mode") == "full") != F.col("can_excerpt"), "excerpt mode"),
        F.when(~F.col("excerpt_mode").isin("full", "summarize", "link"), "unknown mode"),
    ]
    if has("source_name", "heading_path"):
        expected = F.format_string(LINK_TEXT, "source_name", "heading_path", "source_name", "page_title")
        rules.append(F.when(linked & (F.col("can_excerpt") | (F.col("excerpt_mode") != "link") | (F.col("text") != expected)), "link-only body"))
    for c, least in (("ordinal", 0), ("part", 0), ("part_count", 1)):
        if has(c):
            rules.append(F.when(F.col(c).isNull() | (F.col(c) < least), c.replace("_", " ")))
    return joined.select("chunk_id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def fingerprint(columns: list[str]):
    """A hash over columns; every value has its length before it, and a null is told from an empty string."""
    text = lambda c: F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit("="), text(c)), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def delta(before: DataFrame, after: DataFrame, columns: list[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """(key, change) with change added, changed, removed or unchanged; swapped sides are the rollback.

    By default all published columns that either side has are compared; one that a side lacks is null there.
    """
    if columns is None:
        known = SOURCE_FIELDS if key == "source_id" else CHUNK_FIELDS
        columns = [c for c in known if c in before.columns or c in after.columns]

    def marked(side: DataFrame, name: str) -> DataFrame:
        lacking = {c: F.lit(None).cast("string") for c in columns if c not in side.columns}
        return (side.withColumns(lacking) if lacking else side).select(key, fingerprint(columns).alias(name))

    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return marked(before, "b").join(marked(after, "a"), key, "full_outer").select(key, change.alias("change"))


def apply_delta(before: DataFrame, after: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """P5: the old snapshot without what was removed or changed, and the new rows in their place."""
    gone = changes.where("change IN ('removed', 'changed')").select(key)
    new = changes.where("change IN ('added', 'changed')").select(key)
    return before.join(gone, key, "left_anti").unionByName(after.join(new, key, "left_semi"))


@dataclass(frozen=True)
class Snapshot:
    """The two corpus tables that are published together."""

    sources: DataFrame
    chunks: DataFrame


def corpus_delta(before: Snapshot, after: Snapshot) -> DataFrame:
    """(part, id, change) of both tables, part being sources or chunks; swapped sides are the rollback."""
    sources = delta(before.sources, after.sources, key="source_id").select(F.lit("sources").alias("part"), F.col("source_id").alias("id"), "change")
    chunks = delta(before.chunks, after.chunks).select(F.lit("chunks").alias("part"), F.col("chunk_id").alias("id"), "change")
    return sources.unionByName(chunks)


def apply_corpus_delta(before: Snapshot, after: Snapshot, changes: DataFrame) -> Snapshot:
    """P5: both tables after the changes of :func:`corpus_delta`; no other table is touched."""
    of = lambda part, key: changes.where(F.col("part") == part).select(F.col("id").alias(key), "change")
    return Snapshot(
        apply_delta(before.sources, after.sources, of("sources", "source_id"), "source_id"), apply_delta(before.chunks, after.chunks, of("chunks", "chunk_id"))
    )


def coverage_loss(before: DataFrame, after: DataFrame, share: float = 0.8, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Sources, and the whole corpus as null, that keep less than ``share`` of their chunks.

    Sources in ``allowed`` may lose; the whole corpus may not, whoever lost.
    """
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    by_source = count(before, "before").join(count(after, "after"), "source_id", "full_outer").na.fill(0, ["before", "after"])
    lost = by_source.where((F.col("after") < F.col("before") * share) & ~F.col("source_id").isin(*allowed))
    whole = by_source.agg(F.lit(None).cast("string").alias("source_id"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return lost.unionByName(whole.where(F.col("after") < F.floor(F.col("before") * share)))


def manifest(chunks: DataFrame) -> DataFrame:
    """Chunks and characters per source, and the corpus's epoch beside each."""
    by_source = chunks.groupBy("source_id").agg(F.count("*").alias("sections"), F.sum("char_len").alias("chars"))
    return by_source.join(F.broadcast(epoch(chunks)))  # one row


def manifest_mismatches(stated: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, problem) where a stated manifest does not match the corpus: sources, sections or epoch."""
    now = manifest(chunks).select("source_id", F.col("sections").alias("n"), F.col("epoch").alias("e"))
    joined = stated.join(now, "source_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "no chunks").when(F.col("sections").isNull(), "not listed").when(F.col("n") != F.col("sections"), "sections").when(F.col("e") != F.col("epoch"), "epoch")
    return joined.select("source_id", problem.alias("problem")).where("problem IS NOT NULL")


EPOCH_FIELDS = ["chunk_id", "content_hash", "source_url", "can_excerpt", "excerpt_mode", "license"]


def epoch(chunks: DataFrame, digits: int = 3) -> DataFrame:
    """16 hex characters over the chunks' lines (id, hash, URL, excerpt flag, mode, licence).

    A line's hash goes into a block by its source and first ``digits`` hex digits; a block is the hash of its
    ordered lines, a source that of its ordered blocks, the epoch that of the ordered sources.  So a source
    of any size is spread over ``16**digits`` groups.  Columns that chunks lack count as null.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) if c in chunks.columns else F.lit("~") for c in EPOCH_FIELDS]
    lines = chunks.select("source_id", F.sha2(F.concat_ws("|", *parts), 256).alias("line"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    blocks = lines.groupBy("source_id", F.substring("line", 1, digits).alias("head")).agg(joined("line").alias("h"))
    in_order = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n"), 256)
    sources = blocks.groupBy("source_id").agg(in_order("head").alias("h"))
    return sources.agg(F.substring(in_order("source_id"), 1, 16).alias("epoch"))


def publication_summary(changes: DataFrame) -> DataFrame:
    """How many rows each kind of change has, by part where the changes are of both tables."""
    n = lambda kind: F.sum((F.col("change") == kind).cast("long")).alias(kind)
    counts = [n("added"), n("changed"), n("removed"), n("unchanged")]
    return changes.groupBy("part").agg(*counts) if "part" in changes.columns else changes.agg(*counts)


def restore_mismatches(baseline: DataFrame, stored: DataFrame) -> DataFrame:
    """P10: (chunk_id, problem) where stored vectors don't match the baseline's ids and hashes."""
    b = baseline.select("chunk_id", F.col("content_hash").alias("b"))
    joined = b.join(stored.select("chunk_id", F.col("content_hash").alias("s")), "chunk_id", "full_outer")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("b") != F.col("s"), "hash")
    return joined.select("chunk_id", problem.alias("problem")).where("problem IS NOT NULL")
