"""The question log as streams: bucket counts, admission, ledgers, live digests, frame assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundtable.operators.evaluation import STREAM_ERROR, response_fields, typed_frames
from groundtable.operators.logs import DEFAULTS, LogParams
from groundtable.operators.publication import delta
from groundtable.plans.shared import shared_path, spill

LATE = "10 minutes"


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, with the table's own schema.

    The source takes folders or patterns, so a table of one file is named by a pattern.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what there is now, exactly once, into the shared folder, and return what it wrote."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def bucket_counts(log: DataFrame, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """Requests per caller and tumbling window; a window is final once the watermark has passed it."""
    counted = log.withWatermark("ts", late).groupBy("caller", F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select("caller", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def _hours_on(state: GroupState, micros: int, hours: int) -> None:
    state.setTimeoutTimestamp(max(int(micros) // 1000, state.getCurrentWatermarkMs()) + hours * 3_600_000)


def admission_stream(requests: DataFrame, params: LogParams = DEFAULTS, buckets: int = 64) -> DataFrame:
    """Admission with the minute's and the day's counts of each caller kept as state.

    Requests of a batch are taken in time order; those of an earlier batch came first.  State is kept per day and
    bucket of callers, because a group costs far more than a request: a task gathers four values for each
    request of one bucket, day and batch.  The state is dropped when event time is 25 hours past its last request.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts = {c: seen for c, *seen in zip(*state.get)} if state.exists else {}
        rows, admitted = pd.concat(list(frames)).sort_values(["micros", "log_id"]), []
        for caller, micros, signed_in in zip(rows["caller"], rows["micros"].tolist(), rows["signed_in"].tolist()):
            minute, in_minute, in_day = counts.get(caller, (-1, 0, 0))
            this = int(micros) // 60_000_000
            in_minute = in_minute if this == minute else 0
            ok = in_minute < params.per_minute and in_day < (params.per_day_signed_in if signed_in else params.per_day)
            admitted.append(ok)
            counts[caller] = (this, in_minute + ok, in_day + ok)
        state.update(([*counts], *([*column] for column in zip(*counts.values()))))
        _hours_on(state, rows["micros"].max(), 25)
        yield pd.DataFrame({"log_id": rows["log_id"], "caller": rows["caller"], "admitted": admitted})

    bucket = F.pmod(F.xxhash64("caller"), F.lit(buckets)).alias("bucket")
    keyed = requests.withWatermark("ts", LATE).select(
        "log_id", F.col("caller").cast("string").alias("caller"), "ts", F.to_date("ts").cast("string").alias("day"), F.unix_micros("ts").alias("micros"), "signed_in", bucket
    )
    made = keyed.groupBy("day", "bucket").applyInPandasWithState(
        step, "log_id long, caller string, admitted boolean", "callers array<string>, minutes array<long>, in_minute array<int>, in_day array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return made.withColumn("caller", F.col("caller").cast("long"))


def cache_stream(log: DataFrame, days: int = DEFAULTS.cache_days) -> DataFrame:
    """(log_id, question, hit): the first to ask a question misses, and those within ``days`` after an answer hit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        written = state.get[0] if state.exists else None
        rows, hits = pd.concat(list(frames)).sort_values(["micros", "log_id"]), []
        for micros in rows["micros"]:
            hit = written is not None and micros - written < days * 86_400_000_000
            written = written if hit else int(micros)
            hits.append(hit)
        state.update((written,))
        _hours_on(state, written, days * 24)
        yield pd.DataFrame({"log_id": rows["log_id"], "question": key[0], "hit": hits})

    keyed = log.withWatermark("ts", LATE).select("log_id", "question", "ts", F.unix_micros("ts").alias("micros"))
    return keyed.groupBy("question").applyInPandasWithState(step, "log_id long, question string, hit boolean", "written long", "append", GroupStateTimeout.EventTimeTimeout)


def first_asks(log: DataFrame, days: int = DEFAULTS.cache_days) -> DataFrame:
    """The first ask of each question within the cache's life; later ones are dropped."""
    return log.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["question"])


def ledger_stream(usage: DataFrame, path: str, fold) -> None:
    """T4: each batch's ledger is written under its own number, so a repeated batch replaces itself; readers fold all."""

    def write(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    usage.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def live_digest(log: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """T5: totals over sliding windows; rows later than the watermark are not counted."""
    counted = log.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(
        F.count("*").alias("questions"), F.sum(F.col("below_threshold").cast("long")).alias("refused"), F.sum(F.col("cache_hit").cast("long")).alias("cached")
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "questions", "refused", "cached")


def frame_assembly(frames: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """E5 live; a response is emitted when its ``done`` frame comes, or incomplete once event time (``ts``)
    is ``wait_ms`` past its last frame.

    Frames are typed by column expressions before the fold, and a response's fields are read after it, by the
    expressions of E5; state holds the texts, evidence and events so far and the last meta and degrade frames.
    Frames of one response arrive in order of ``seq`` within a batch.
    """
    columns = ["answer", "beyond", "evidence", "events", "meta", "degrade", "error", "complete"]
    kinds = "answer string, beyond string, evidence array<string>, events array<string>, meta string, degrade string, error string, complete boolean"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answer, beyond, evidence, events, meta, degrade, error, done = state.get if state.exists else ("", "", [], [], None, None, None, False)
        evidence, events = list(evidence), list(events)
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("seq")
            of = {event: found for event, found in rows.groupby("event")}
            text = lambda event: "".join(of[event]["t"].dropna()) if event in of else ""
            last = lambda event, before: of[event]["body"].iloc[-1] if event in of else before
            answer, beyond = answer + text("token"), beyond + text("beyond")
            evidence += list(of["evidence"]["body"]) if "evidence" in of else []
            events += list(rows["event"])
            meta, degrade = last("meta", meta), last("degrade", degrade)
            error, done = STREAM_ERROR if "error" in of else error, done or "done" in of
        folded = (answer, beyond, evidence, events, meta, degrade, error, done)
        if done or state.hasTimedOut:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], *folded)], columns=["response_id", *columns])
        else:
            state.update(folded)
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait_ms)

    typed = typed_frames(frames.withWatermark("ts", LATE)).select("response_id", "ts", "seq", "event", "t", "body")
    folded = typed.groupBy("response_id").applyInPandasWithState(step, f"response_id long, {kinds}", kinds, "append", GroupStateTimeout.EventTimeTimeout)
    return response_fields(folded)


def current(spark: SparkSession, path: str, kind: str, before: int | None = None) -> DataFrame:
    """T7's ``chunks`` or ``postings`` as they stand after all batches, or after those below ``before``."""
    changes = spark.read.parquet(f"{path}/changes").where(F.lit(True) if before is None else F.col("batch") < before)
    last = changes.groupBy("chunk_id").agg(F.max("batch").alias("batch"), F.max_by("change", "batch").alias("change"))
    return spark.read.parquet(f"{path}/{kind}").join(last.where("change != 'removed'"), ["chunk_id", "batch"], "left_semi").drop("batch")


def corpus_updates(documents: DataFrame, path: str, chunk, post, page: str = "doc_id", version: str | None = None) -> None:
    """Each batch of new, changed and withdrawn pages becomes changes of chunks, postings and vectors due.

    A page comes with all of its text: chunks that it had and has no more are removed, and so are all of a
    page without text.  Of a page's rows in one batch that of the largest ``version`` counts; equal ones go
    by a hash of the row.  ``chunk`` keeps the page's column.  A batch is written under its number, its
    changes last, and reads earlier ones only, so a repeated batch replaces itself.  :func:`current` reads
    the newest state; ``dirty`` lists each batch's chunks whose vectors must be made (V1).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, save = batch.sparkSession, lambda df, kind: df.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        order = Window.partitionBy(page).orderBy(*([F.desc(version)] if version else []), F.xxhash64(*batch.columns))
        pages = batch.withColumn("_place", F.row_number().over(order)).where((F.col("_place") == 1) | F.col(page).isNull()).drop("_place")
        made = spill(chunk(pages), "t7-made")
        stood = current(spark, path, "chunks", number) if number else made.limit(0)
        old = spill(stood.join(batch.select(page).distinct(), page, "left_semi"), "t7-old")
        changes = spill(delta(old, made).where("change != 'unchanged'"), "t7-changes")
        fresh = made.join(changes.where("change != 'removed'"), "chunk_id", "left_semi")
        save(fresh, "chunks")
        save(post(fresh), "postings")
        save(fresh.join(old, ["chunk_id", "content_hash"], "left_anti").select("chunk_id", "content_hash"), "dirty")
        save(changes, "changes")

    documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
