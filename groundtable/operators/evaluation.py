"""Retrieval quality, answer benchmarks and publishing decisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtable.operators.vectors import question_blocks
from groundtable.plans.shared import short_batches, spill

_WORDS = re.compile("[A-Za-z0-9]+")


def passage_truth(questions: DataFrame, chunks: DataFrame, block: int = 256) -> DataFrame:
    """(question_id, chunk_id) where the chunk contains the question's text.

    The words inside a question (neither the first nor the last, which the chunk may continue) occur whole in
    a chunk that contains it, so candidates share its rarest inner word and the test of containment follows
    an equi-join.  Questions without inner words are looked for in every chunk, ``block`` of them at a time.
    """
    runs = F.split(F.col("question"), "[^A-Za-z0-9]+")
    inner = F.array_distinct(F.filter(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 2, F.lit(0))), lambda w: w != ""))
    words = questions.select("question_id", "question", inner.alias("words"))
    pairs = None
    for asked in question_blocks(words.select("question_id", F.explode("words").alias("term")), block):
        wanted = spill(_asked_words(chunks, sorted(set(asked.column("term").to_pylist()))), "asked-words")
        frequency = wanted.groupBy("term").agg(F.count("*").alias("n"))
        sought = questions.sparkSession.createDataFrame(asked)
        rarest = sought.join(frequency, "term", "left").groupBy("question_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r")).select("question_id", "r.term")
        met = rarest.join(wanted, "term").select("question_id", "chunk_id")
        pairs = met if pairs is None else pairs.unionByName(met)
    joined = pairs.join(questions, "question_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    found = joined.where(F.contains("text", "question")).select("question_id", "chunk_id")
    bare = words.where(F.size("words") == 0).select("question_id", "question")
    count = bare.count()
    for number in range(-(-count // block)):
        held = bare.where(F.pmod(F.xxhash64("question_id"), F.lit(-(-count // block))) == number).collect()  # about ``block`` questions
        hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(r["question"])), F.lit(r["question_id"])) for r in held]))
        found = found.unionByName(chunks.select(F.explode(hits).alias("question_id"), "chunk_id"))
    return found


def _asked_words(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, term) of the words of a chunk that are among ``terms``, found where the chunk is read."""
    held = chunks.sparkSession.sparkContext.broadcast(frozenset(terms))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [sorted(held.value.intersection(_WORDS.findall(text))) for text in batch.column("text").to_pylist()]
            at = pa.array([i for i, found in enumerate(met) for _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(at), pa.array([t for found in met for t in found], pa.string())], ["chunk_id", "term"])

    short_batches(chunks.sparkSession)
    return chunks.where("text IS NOT NULL").select("chunk_id", "text").mapInArrow(find, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, term string")


def retrieval_quality(listed: DataFrame, truth: DataFrame, k: int = 6) -> DataFrame:
    """Recall at k and mean reciprocal rank per kind of list; questions without a hit count as 0."""
    hits = listed.join(truth, ["question_id", "chunk_id"]).groupBy("question_id", "kind").agg(F.min("rank").alias("rank"))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("keyword", "semantic", "hybrid")]))
    grid = truth.select("question_id").distinct().withColumn("kind", kinds)
    scored = grid.join(hits, ["question_id", "kind"], "left")
    return scored.groupBy("kind").agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def gate_audit(gated: DataFrame, truth: DataFrame) -> DataFrame:
    """Wrong refusals of answerable questions, wrong passes of others, and how far scores separate."""
    marked = gated.join(truth.select("question_id").distinct().withColumn("on_topic", F.lit(True)), "question_id", "left").withColumn(
        "on_topic", F.coalesce("on_topic", F.lit(False))
    )
    on, passed = F.col("on_topic"), F.col("pass")
    return marked.agg(
        F.count("*").alias("questions"),
        F.sum((on & ~passed).cast("long")).alias("false_negatives"),
        F.sum((~on & passed).cast("long")).alias("false_positives"),
        F.round(F.min(F.when(on, F.col("best_cosine"))), 6).alias("least_on_topic"),
        F.round(F.max(F.when(~on, F.col("best_cosine"))), 6).alias("most_off_topic"),
    )


def source_routing(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether the expected source, or a stand-in for it, is among a question's results."""
    sources = results.groupBy("question_id").agg(F.collect_set("source_id").alias("found"))
    routed = F.array_contains("found", F.col("source_id")) | F.arrays_overlap("found", "stand_ins")
    return expected.join(sources, "question_id", "left").select("question_id", "source_id", F.coalesce(routed, F.lit(False)).alias("routed"))


def publish_decision(audit: DataFrame, routing: DataFrame) -> DataFrame:
    """One row; nothing is published while the gate or the routing fails anywhere."""
    routes = routing.agg(F.bool_and("routed").alias("all_routed"))
    return audit.join(F.broadcast(routes)).select(
        (F.col("all_routed") & (F.col("false_negatives") == 0) & (F.col("false_positives") == 0)).alias("publish")
    )


def _kind(value: Column) -> Column:
    """The JSON type of a variant: OBJECT, ARRAY, STRING, BOOLEAN, ...; null where there is no such field."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _field(body: Column, name: str, kind: str) -> Column:
    """A field of a variant, null where it has another JSON type: "true" is no truth value, 5 no text."""
    value = F.try_variant_get(body, f"$.{name}", "variant")
    return F.when(_kind(value) == {"string": "STRING", "boolean": "BOOLEAN"}[kind], F.try_variant_get(body, f"$.{name}", kind))


def typed_frames(frames: DataFrame) -> DataFrame:
    """The frames that count, with ``t``, the text of token and beyond frames, and ``body``, the JSON of the others.

    ``data`` is JSON; a frame counts if that is an object or an array, whatever its event.
    """
    body = F.try_parse_json("data")
    held = frames.withColumn("_body", body).where(_kind(F.col("_body")).isin("OBJECT", "ARRAY"))
    spoken = F.col("event").isin("token", "beyond")
    return held.withColumn("t", F.when(spoken, _field(F.col("_body"), "t", "string"))).withColumn(
        "body", F.when(~spoken, F.to_json("_body"))
    ).drop("_body", "data")


def response_fields(folded: DataFrame) -> DataFrame:
    """The columns of a response from its last meta and degrade frames' JSON.

    ``folded`` has response_id, answer, beyond, evidence and events (arrays), meta, degrade, error and complete.  Without
    a meta frame, as with one that lacks the field or has it in another type, lists are empty, ``refused`` is
    false, and ``private_context`` and ``cached`` are null.
    """
    meta, degrade = F.parse_json("meta"), F.parse_json("degrade")

    def listed(name: str) -> Column:
        return F.coalesce(F.transform(F.when(_kind(F.try_variant_get(meta, f"$.{name}", "variant")) == "ARRAY", F.try_variant_get(meta, f"$.{name}", "array<variant>")), lambda v: F.to_json(v)), F.array().cast("array<string>"))

    reason = F.try_variant_get(degrade, "$.reason", "string")
    return folded.select(
        "response_id", "answer", "beyond", listed("citations").alias("citations"), listed("excerpts").alias("excerpts"), "evidence",
        "complete", F.col("degrade").isNotNull().alias("degraded"),
        F.when(F.col("degrade").isNotNull(), F.when(F.coalesce(reason, F.lit("")).isin("", "0", "false"), "unknown").otherwise(reason)).alias("degrade_reason"),
        F.when(F.col("degrade").isNotNull(), F.coalesce(_field(degrade, "answerMd", "string"), F.lit(""))).alias("fallback_answer"),
        F.coalesce(_field(meta, "refused", "boolean"), F.lit(False)).alias("refused"),
        _field(meta, "privateContext", "boolean").alias("private_context"), _field(meta, "cached", "boolean").alias("cached"),
        F.when(_kind(F.try_variant_get(meta, "$.tutor", "variant")).isin("OBJECT", "ARRAY"), F.to_json(F.try_variant_get(meta, "$.tutor", "variant"))).alias("tutor"),
        "error", "events",
    )


STREAM_ERROR = "stream-error"  # fixed value: what an error frame leaves


def assemble_frames(frames: DataFrame) -> DataFrame:
    """E5: (response_id, seq, event, data) frames to one row per response, as :func:`response_fields` lists them.

    Texts and evidence follow ``seq``; of several meta or degrade frames the last one counts.  A response
    whose frames all lack a JSON object has a row without content.
    """
    def joined(event: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == event, F.struct("seq", "t")))), lambda p: p["t"]), "")

    def last(event: str) -> Column:
        return F.max_by(F.when(F.col("event") == event, F.col("body")), F.when(F.col("event") == event, F.col("seq")))

    folded = typed_frames(frames).groupBy("response_id").agg(
        joined("token").alias("answer"), joined("beyond").alias("beyond"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "evidence", F.struct("seq", "body")))), lambda p: p["body"]).alias("evidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda p: p["event"]).alias("events"),
        last("meta").alias("meta"), last("degrade").alias("degrade"),
        F.max(F.when(F.col("event") == "error", STREAM_ERROR)).alias("error"), F.bool_or(F.col("event") == "done").alias("complete"),
    )
    blank, none = F.lit(""), F.array().cast("array<string>")
    whole = frames.select("response_id").distinct().join(folded, "response_id", "left").select(
        "response_id", F.coalesce("answer", blank).alias("answer"), F.coalesce("beyond", blank).alias("beyond"), F.coalesce("evidence", none).alias("evidence"),
        F.coalesce("events", none).alias("events"), "meta", "degrade", "error", F.coalesce("complete", F.lit(False)).alias("complete"),
    )
    return response_fields(whole)


def recorded_responses(responses: DataFrame) -> DataFrame:
    """Assembled responses as :func:`structural_checks` takes them; each is asked for citations."""
    return responses.select(
        F.col("response_id").alias("case_id"), F.lit("done").alias("status"), "error", "complete", "degraded", "degrade_reason", "refused",
        F.col("private_context").alias("private"), "cached", "answer", F.lit(True).alias("required"),
        F.transform("citations", lambda c: F.get_json_object(c, "$.n").cast("int")).alias("cited"),
    )


# What a structural failure is called.
FAILURES = {
    "not run": "No answer recorded.",
    "shared": "Worker response indicates shared context or cache; benchmark requests must stay private.",
    "incomplete": "No terminal done event.",
    "degraded": "Source-only fallback (%s).",
    "refused": "The scenario was refused; reviewer must investigate.",
    "empty": "No grounded answer text.",
    "uncited": "Required citations are absent.",
    "dangling": "Citation [%d] has no source record.",
}


def structural_checks(responses: DataFrame) -> DataFrame:
    """(case_id, status, failures) of recorded responses; describes structure, not truth.

    Needs case_id, status, error, complete, degraded, degrade_reason, refused, private, cached, answer, required
    and cited (array of numbers).
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?s)```.*?```", " "), r"`[^`]*`", " ")
    marks = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(r"(?<!\w)\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)), lambda m: F.split(m, r"\s*,\s*")))
    cited = F.coalesce("cited", F.array().cast("array<int>"))
    dangling = F.array_except(F.transform(marks, lambda m: m.cast("int")), cited)
    blank = F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\s+", " ")) == ""
    say = FAILURES
    found = F.array_compact(
        F.array(
            F.when(~F.coalesce("private", F.lit(True)) | F.coalesce("cached", F.lit(False)), say["shared"]),
            F.col("error"),
            F.when(~F.col("complete"), say["incomplete"]),
            F.when(F.col("degraded"), F.format_string(say["degraded"], F.coalesce("degrade_reason", F.lit("unknown")))),
            F.when(F.col("refused"), say["refused"]),
            F.when(blank, say["empty"]),
            F.when(F.col("required") & (F.size(cited) == 0), say["uncited"]),
        )
    )
    failures = F.array_distinct(F.concat(found, F.transform(dangling, lambda n: F.format_string(say["dangling"], n))))
    made = responses.select("case_id", F.when(F.col("status") == "not-run", F.array(F.lit(say["not run"]))).otherwise(failures).alias("failures"), F.col("status").alias("run"))
    status = F.when(F.col("run") == "not-run", "not-run").when(F.size("failures") > 0, "failed").otherwise("ready-for-review")
    return made.select("case_id", status.alias("status"), "failures")


def score_judgments(checked: DataFrame, judgments: DataFrame) -> DataFrame:
    """Review status of each case; only structurally ready ones are scored, human and model apart."""
    joined = checked.join(judgments, "case_id", "left")
    passed = F.least("correctness", "usefulness", "citation_support") >= 3
    status = (
        F.when(F.col("status") != "ready-for-review", F.col("status"))
        .when(F.col("reviewer_type").isNull(), "awaiting-human-review")
        .when(F.col("reviewer_type") == "human", F.when(passed, "passed").otherwise("failed-human-review"))
        .otherwise(F.when(passed, "passed-model-review").otherwise("failed-model-review"))
    )
    ready = F.col("status") == "ready-for-review"
    return joined.select(
        "case_id", status.alias("review_status"), F.when(ready, F.col("reviewer_type")).alias("reviewer_type"),
        *[F.when(ready, F.col(c)).alias(c) for c in ("correctness", "usefulness", "citation_support")],
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Counts and means of a run; quality stands only if every case passed human review."""
    human, model = F.col("reviewer_type") == "human", F.col("reviewer_type") == "model"
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    status = F.col("review_status")
    means = [
        F.round(F.avg(F.when(who, F.col(score))), 2).alias(f"{name}_{score}")
        for name, who in (("human", human), ("model", model)) for score in ("correctness", "usefulness", "citation_support")
    ]
    made = scored.agg(
        F.count("*").alias("total"), n(human).alias("human_reviewed"), n(model).alias("model_reviewed"), n(status == "passed").alias("passed"),
        n(status == "passed-model-review").alias("model_passed"), n(status.isin("failed", "failed-human-review", "failed-model-review")).alias("failures"),
        n(status == "failed").alias("failed"), *means,
    )
    pending = F.col("total") - F.col("human_reviewed") - F.col("failed")  # a model's review is provisional
    established = (F.col("total") > 0) & (F.col("passed") == F.col("total")) & (F.col("human_reviewed") == F.col("total"))
    return made.withColumn("pending", pending).withColumn("quality_established", established).drop("failed")


def dataset_hash(cases: DataFrame) -> DataFrame:
    """One row with a hash over the data set's cases, in order of their ids: 1,000 ids make a block, blocks are hashed in order."""
    line = F.sha2(F.to_json(F.struct(*sorted(cases.columns)), {"ignoreNullFields": "false"}), 256)
    blocks = cases.groupBy(F.floor(F.col("case_id") / 1000).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", line.alias("l")))), lambda x: x["l"]), ""), 256).alias("h"))
    return blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("dataset_hash"))


def run_integrity(records: DataFrame, cases: DataFrame, judgments: DataFrame | None = None, recorded_hash: str | None = None) -> DataFrame:
    """(case_id, problem): repeated and unknown cases of a run, judgments of unknown cases, without a rationale,
    with scores outside 0 to 4 or by neither human nor model, and a run recorded over another data set (no case_id)."""
    repeated = records.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate").alias("problem"))
    unknown = records.join(cases.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("unknown").alias("problem")).distinct()
    found = repeated.unionByName(unknown)
    if judgments is not None:
        scores = [F.col(c).isNull() | ~F.col(c).between(0, 4) for c in ("correctness", "usefulness", "citation_support")]
        problems = F.array_compact(
            F.array(
                F.when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "no rationale"), F.when(scores[0] | scores[1] | scores[2], "score out of range"),
                F.when(~F.coalesce("reviewer_type", F.lit("human")).isin("human", "model"), "reviewer"),
            )
        )
        stray = judgments.join(cases.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("judgment of an unknown case").alias("problem"))
        found = found.unionByName(stray).unionByName(judgments.select("case_id", F.explode(problems).alias("problem")))
    if recorded_hash is not None:
        changed = dataset_hash(cases).where(F.col("dataset_hash") != recorded_hash).select(F.lit(None).cast("long").alias("case_id"), F.lit("data set changed").alias("problem"))
        found = found.unionByName(changed)
    return found


def select_cases(cases: DataFrame, category: str | None = None, ids: list[int] | None = None, limit: int = 40) -> DataFrame:
    """Cases by category or ids, at most ``limit`` (1 to 40) in the data set's order."""
    chosen = cases
    if category is not None:
        chosen = chosen.where(F.col("category") == category)
    if ids is not None:
        chosen = chosen.where(F.col("case_id").isin(ids))
    return chosen.orderBy("case_id").limit(max(1, min(40, limit)))
