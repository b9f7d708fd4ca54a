"""The usage tables (questions asked, feedback, requests, token use) as views of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_log(events: DataFrame) -> DataFrame:
    """One row per question: what was asked, by whom, and how it was answered."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("caller"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("question"),
        (kind == "error").alias("below_threshold"),
        (kind == "view").alias("cache_hit"),
        kind.isin("purchase", "click").alias("llm_called"),
        (kind == "signup").alias("degraded"),
        (F.col("value") / (1 + F.col("value"))).alias("best_cosine"),
        F.round(F.col("value") * 10, 2).alias("latency_ms"),
        (k % 7).alias("cite_checked"),
        F.least(k % 3, k % 7).alias("cite_weak"),
        k.alias("k"),
        (k % 11 == 0).alias("private"),
    )


def feedback(events: DataFrame) -> DataFrame:
    """Verdicts on answers; the reason is missing for even k."""
    log = query_log(events).where(F.col("question").rlike("^(click|error) "))
    return log.select(
        F.col("log_id").alias("feedback_id"),
        "ts",
        "question",
        F.when(F.col("question").startswith("click"), "up").otherwise("down").alias("verdict"),
        F.when(F.col("k") % 2 == 1, F.element_at(F.array(F.lit("wrong"), F.lit("too long"), F.lit("too vague")), F.col("k") % 3 + 1)).alias("reason"),
    )


LOG_SQL = r"""log AS (
  SELECT event_id AS log_id, ts, user_id AS caller,
         event_type || ' ' || regexp_extract(props, '"k": *(\d+)', 1) AS question,
         event_type = 'error' AS below_threshold, event_type = 'view' AS cache_hit,
         event_type IN ('purchase', 'click') AS llm_called, event_type = 'signup' AS degraded,
         value / (1 + value) AS best_cosine, round(value * 10, 2) AS latency_ms,
         CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k,
         k % 7 AS cite_checked, least(k % 3, k % 7) AS cite_weak, k % 11 = 0 AS private
  FROM events
)"""
FEEDBACK_SQL = LOG_SQL + r""", feedback AS (
  SELECT log_id AS feedback_id, ts, question, CASE WHEN question LIKE 'click %' THEN 'up' ELSE 'down' END AS verdict,
         CASE WHEN k % 2 = 1 THEN ['wrong', 'too long', 'too vague'][k % 3 + 1] END AS reason
  FROM log WHERE question LIKE 'click %' OR question LIKE 'error %'
)"""
