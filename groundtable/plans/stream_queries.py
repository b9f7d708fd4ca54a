"""Registered streaming queries, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtable.operators import keyword, logs
from groundtable.plans.audit_queries import FRAMES_SQL, LINES_SQL, MARKED_SQL, frames, marked_answers, plain_lists
from groundtable.plans.log_queries import ADMISSION_SQL, _LEDGER_SQL, _day, _moment, _usage_columns
from groundtable.plans.registry import query, table
from groundtable.plans.shared import shared_path
from groundtable.sources import corpus
from groundtable.sources.usage_log import LOG_SQL, query_log
from groundtable.streaming import log_streams as streams
from groundtable.streaming.answer_split import split_stream


def _log(spark, sf_dir):
    return query_log(streams.read_stream(spark, sf_dir, "events"))


@query("T1_bucket_counts", f"""WITH {LOG_SQL}, b AS (SELECT caller, date_trunc('hour', ts) AS s, count(*) AS requests FROM log GROUP BY ALL)
  SELECT caller, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", requests FROM b
  WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log) - INTERVAL 10 MINUTE""")
def t1(spark, sf_dir):
    return _moment(streams.drain(streams.bucket_counts(_log(spark, sf_dir), "1 hour"), "t1"), "start", "end")


@query("T2_admission_stream", f"WITH {LOG_SQL}{ADMISSION_SQL} SELECT log_id, caller, admitted FROM admission")
def t2(spark, sf_dir):
    asked = _log(spark, sf_dir).withColumn("signed_in", F.col("caller") % 2 == 1).select("log_id", "caller", "ts", "signed_in")
    return streams.drain(streams.admission_stream(asked), "t2")


@query("T3_cache_stream", f"""WITH RECURSIVE {LOG_SQL}, numbered AS (SELECT log_id, question, ts, row_number() OVER (PARTITION BY question ORDER BY ts, log_id) AS i FROM log),
  walk AS (SELECT log_id, question, ts AS written, i, false AS hit FROM numbered WHERE i = 1
    UNION ALL SELECT n.log_id, n.question, CASE WHEN n.ts < w.written + INTERVAL 30 DAY THEN w.written ELSE n.ts END, n.i, n.ts < w.written + INTERVAL 30 DAY FROM walk w JOIN numbered n ON n.question = w.question AND n.i = w.i + 1)
  SELECT log_id, question, hit FROM walk""")
def t3(spark, sf_dir):
    return streams.drain(streams.cache_stream(_log(spark, sf_dir)), "t3")


@query("T4_ledger_stream", f"WITH {_LEDGER_SQL} SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM ledger")
def t4(spark, sf_dir):
    path = shared_path(spark, "t4")
    streams.ledger_stream(_usage_columns(_log(spark, sf_dir)), path, logs.token_ledger)
    return _day(logs.merge_ledgers(spark.read.parquet(f"{path}/ledger").drop("batch")))


@query("T5_live_digest", f"""WITH {LOG_SQL}, w AS (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * d AS s, below_threshold, cache_hit FROM log, range(7) t(d))
  SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS questions, CAST(sum(below_threshold::INT) AS BIGINT) AS refused,
    CAST(sum(cache_hit::INT) AS BIGINT) AS cached FROM w WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR GROUP BY s""")
def t5(spark, sf_dir):
    return _moment(streams.drain(streams.live_digest(_log(spark, sf_dir)), "t5"), "start", "end")


@query("T6_frame_assembly", f"WITH {FRAMES_SQL} SELECT * EXCLUDE (lapsed) FROM responses WHERE complete OR lapsed")
def t6(spark, sf_dir):
    """Finished responses, and unfinished ones that event time has left behind."""
    turns = streams.read_stream(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds((F.col("conv_id") + 1) * 60 + F.col("turn")))
    return plain_lists(streams.drain(streams.frame_assembly(frames(turns)), "t6"))


@query("T6_split_stream", f"WITH {LINES_SQL}, {MARKED_SQL} SELECT answer_id AS response_id, grounded, beyond FROM split")
def t6_split(spark, sf_dir):
    """Answers cut into pieces of 23 characters, split while they arrive, and put together again."""
    answers = marked_answers(streams.read_stream(spark, sf_dir, "conversations")).withColumn("ts", F.timestamp_seconds(F.col("answer_id")))
    pieces = F.concat(F.regexp_extract_all("text", F.lit("(?s).{1,23}"), F.lit(0)), F.array(F.lit(None).cast("string")))
    frames = answers.select(F.col("answer_id").alias("response_id"), "ts", F.posexplode(pieces).alias("seq", "data"))
    made = streams.drain(split_stream(frames.withColumn("event", F.when(F.col("data").isNull(), "done").otherwise("token"))), "t6-split")
    part = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("seq", "text")))), lambda x: x["text"]), "")
    return made.groupBy("response_id").agg(part("grounded").alias("grounded"), part("beyond").alias("beyond"))


@query("T7_corpus_updates", f"WITH {corpus.CHUNKS_SQL} SELECT chunk_id, content_hash FROM chunks")
def t7(spark, sf_dir):
    """Two batches: the first lacks pages, has others with an older text and some that the second withdraws."""
    path = shared_path(spark, "t7")
    docs = table(spark, sf_dir, "documents")
    kind, text = F.coalesce(F.col("doc_id") % 10, F.lit(0)), F.col("text")
    extra = docs.where(kind == 7).withColumn("doc_id", -1 - F.col("doc_id"))
    older = docs.where(kind != 3).withColumn("text", F.when(kind == 5, F.concat(text, F.lit(" outdated"))).otherwise(text))
    first = older.unionByName(extra)
    second = docs.where(kind.isin(3, 5)).unionByName(extra.withColumn("text", F.lit(None).cast("string")))
    for pages in (first, second):
        pages.write.mode("append").option("compression", "zstd").parquet(f"{path}/pages")
        streams.corpus_updates(spark.readStream.schema(docs.schema).parquet(f"{path}/pages"), path, corpus.chunks, keyword.chunk_index)
    return streams.current(spark, path, "chunks").select("chunk_id", "content_hash")


@query("T8_first_asks", f"WITH {LOG_SQL} SELECT DISTINCT question FROM log")
def t8(spark, sf_dir):
    return streams.drain(streams.first_asks(_log(spark, sf_dir)), "t8").select("question")
