"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A document's size is its number of words.  Sources weigh 5, 2, 1, 5, ... in code-point order (null
last) and share all words by these weights; a target stops at ``max_copies`` times its source's
size and the excess goes to the other sources by weight until no target is above its limit.

A document's expected copies are its source's target over its source's size (times its relative
weight, where a weight column is given).  Their whole part is allocated for certain.  For the
fraction ``p`` the documents of a source are ranked by ``(u / (1 - u)) / (p / (1 - p))``, ``u``
being a hash of the id, and one more copy is taken in that order until the words that the target
still lacks are reached, to the nearest document: a sample of fixed size in words.

Ranking a whole source in one task would not scale, so the words are first summed in 65,536 bins of
the rank; only the documents of the one bin in which a source's cut falls are ranked exactly.

Without a weight column all documents of a source have the same odds, so within it the order is that of
the random numbers; odds differ between sources, and between documents where a weight column is given.
What documents at the limit of copies leave over is taken by others in rank order.

* Null text has size 0; such documents are returned and take 0 words.
* Equal ranks go by id, then size.  Reruns on the same rows agree; the seed is a parameter.
* Rows that repeat an id get the same random number.  An empty table gives an empty result.
* Null and negative weights count as 0: such documents are never taken.  Texts of any length are counted whole.
* Input columns beside id, text, source and weight are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtable.plans.shared import spill

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 16


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from the MD5 of seed and id."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(seed), id_col.cast("string"))), 1, 12), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """Adds each source's target to a table (source, source_size) of one row per source.

    Sources whose limit per unit of weight is lowest fill up first, so after sorting by it the
    filled ones are a prefix, and the level of the rest follows from running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limits = (
        totals.withColumn("place", place)
        .withColumn("weight", pick.cast("long"))
        .withColumn("limit", F.col("source_size") * max_copies)
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    ).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    levels = limits.withColumn("level", level)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("rank", "level"))
    final = (
        levels.withColumn("rank", F.row_number().over(order))
        .withColumn("final", F.min(open_level).over(everything)["level"])
    )
    target = F.coalesce(
        F.least(F.col("limit").cast("double"), F.col("final") * F.col("weight")), F.col("limit").cast("double")
    )
    return final.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join a table of one row per source (named ``s``) to documents; a large source is dealt over salted keys."""
    spread = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("salt", "other_salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    match = F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("other_salt"))
    return salted.join(spread, match, how).drop("s", "salt", "other_salt")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    max_copies: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken."""
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    sizes = spill(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            weight.alias("share"),
        ),
        "sizes",
    )
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("share") * F.col("size")).alias("weighed")
    )
    targets = source_targets(totals.select("source", "source_size"), weights, max_copies)
    per_source = targets.alias("t").join(
        totals.select(F.col("source").alias("s"), "weighed"), F.col("t.source").eqNullSafe(F.col("s"))
    ).select(F.col("t.source").alias("s"), "source_size", "target", "weighed")

    joined = _with_source(sizes, per_source)
    if weight_col:
        expected = F.col("target") * F.col("share") / F.col("weighed")
    else:
        expected = F.col("target") / F.col("source_size").cast("double")
    expected = F.least(F.when(F.col("weighed") > 0, expected).otherwise(F.lit(0.0)), F.lit(float(max_copies)))
    u = uniform(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    ranked = (
        joined.withColumn("expected", expected)
        .withColumn("certain", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("certain"))
        .withColumn("u", u)
        .withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bin", F.coalesce(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS)).cast("int"))
    )
    ranked = ranked.select("id", "source", "size", "source_size", "target", "certain", "rank", "bin")

    bins = ranked.groupBy("source", "bin").agg(
        F.sum("size").alias("words"),
        F.sum(F.col("certain") * F.col("size")).alias("certain_words"),
        F.max("target").alias("target"),
    )
    by_source = Window.partitionBy("source")
    lacking = F.col("target") - F.sum("certain_words").over(by_source)
    before = F.coalesce(F.sum("words").over(by_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (
        bins.withColumn("lacking", lacking)
        .withColumn("before", before)
        .where((F.col("bin") < BINS) & (F.col("before") <= F.col("lacking")))
        .groupBy("source")
        .agg(F.max(F.struct("bin", "before", "lacking")).alias("cut"))
        .select(F.col("source").alias("s"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"), F.col("cut.lacking").alias("lacking"))
    )
    placed = _with_source(ranked, cuts, "left")
    within = placed.where(F.col("bin") == F.col("cut_bin"))
    elsewhere = placed.where((F.col("bin") != F.col("cut_bin")) | F.col("cut_bin").isNull())
    order = Window.partitionBy("source", "bin").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    within = within.withColumn("extra", (passed + F.col("size") / 2.0 <= F.col("lacking")).cast("long"))
    elsewhere = elsewhere.withColumn("extra", F.coalesce((F.col("bin") < F.col("cut_bin")).cast("long"), F.lit(0)))
    copies = F.col("certain") + F.col("extra")
    return within.unionByName(elsewhere).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
