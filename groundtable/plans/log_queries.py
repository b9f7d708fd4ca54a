"""Registered queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtable.operators import logs
from groundtable.plans.registry import query, table
from groundtable.sources.usage_log import FEEDBACK_SQL, LOG_SQL, feedback, query_log


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _moment(df, *columns):
    """Times as text, so that every reader prints them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def _log(spark, sf_dir):
    return query_log(table(spark, sf_dir, "events"))


def _log_sql(body: str) -> str:
    return f"WITH {LOG_SQL} {body}"


@query("L1_digest_totals", _log_sql("""
, recent AS (SELECT * FROM log WHERE ts > (SELECT max(ts) FROM log) - INTERVAL 7 DAY)
SELECT count(*) AS questions, CAST(sum(below_threshold::INT) AS BIGINT) AS refused, CAST(sum(cache_hit::INT) AS BIGINT) AS cached,
  CAST(sum(llm_called::INT) AS BIGINT) AS llm, CAST(sum(degraded::INT) AS BIGINT) AS degraded, round(avg(latency_ms)) AS mean_ms,
  CAST(floor(100.0 * sum(below_threshold::INT) / count(*) + 0.5) AS BIGINT) AS refused_pct,
  CAST(floor(100.0 * sum(cache_hit::INT) / count(*) + 0.5) AS BIGINT) AS cached_pct FROM recent"""))
def l1(spark, sf_dir):
    return logs.digest_totals(_log(spark, sf_dir))


@query("L2_refused_top", _log_sql("SELECT question, count(*) AS n FROM log WHERE below_threshold GROUP BY question ORDER BY n DESC, question LIMIT 12"))
def l2(spark, sf_dir):
    return logs.refused_top(_log(spark, sf_dir))


@query("L3_weak_retrieval", _log_sql("""SELECT log_id, question, round(best_cosine, 3) AS cos FROM log
  WHERE llm_called AND best_cosine < 0.68 ORDER BY best_cosine, log_id LIMIT 8"""))
def l3(spark, sf_dir):
    return logs.weak_retrieval(_log(spark, sf_dir))


@query("L4_feedback_reasons", f"WITH {FEEDBACK_SQL} SELECT verdict, coalesce(reason, '(none given)') AS reason, count(*) AS n FROM feedback GROUP BY ALL")
def l4(spark, sf_dir):
    return logs.feedback_reasons(feedback(table(spark, sf_dir, "events")))


@query("L4_latest_negative", f"WITH {FEEDBACK_SQL} SELECT feedback_id, question, reason FROM feedback WHERE verdict = 'down' ORDER BY ts DESC, feedback_id DESC LIMIT 6")
def l4_latest(spark, sf_dir):
    return logs.latest_negative(feedback(table(spark, sf_dir, "events")))


@query("L5_citation_quality", _log_sql("""SELECT CAST(sum(cite_checked) AS BIGINT) AS checked, CAST(sum(cite_weak) AS BIGINT) AS weak, count(*) AS answers,
  round(sum(cite_weak) / sum(cite_checked), 6) AS weak_share, sum(cite_weak) / sum(cite_checked) > 0.3 AS alarm FROM log"""))
def l5(spark, sf_dir):
    return logs.citation_quality(_log(spark, sf_dir))


@query("L6_daily_activity", _log_sql("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS questions, CAST(sum(cache_hit::INT) AS BIGINT) AS cache_hits
  FROM log GROUP BY day ORDER BY day DESC LIMIT 14"""))
def l6(spark, sf_dir):
    return _day(logs.daily_activity(_log(spark, sf_dir)))


@query("L7_distinct_askers", _log_sql("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT caller) AS askers FROM log GROUP BY day"))
def l7(spark, sf_dir):
    return _day(logs.distinct_askers(_log(spark, sf_dir)))


def _usage(spark, sf_dir):
    return _usage_columns(_log(spark, sf_dir))


def _usage_columns(log):
    return log.select(
        "ts",
        F.when(F.col("llm_called"), "answer").otherwise("plan").alias("kind"),
        F.when(F.col("k") % 5 != 0, F.col("k") * 10).alias("prompt"),
        F.when(F.col("k") % 4 == 0, F.col("k")).alias("tool"),
        F.when(F.col("k") % 3 == 0, F.col("k") * 2).alias("thought"),
        F.when(F.col("k") % 2 == 0, F.col("k") * 3).alias("answer"),
        F.when(F.col("k") % 7 == 0, F.col("k") * 20).alias("total"),
    )


_LEDGER_SQL = LOG_SQL + """, used AS (
  SELECT CAST(ts AS DATE) AS day, CASE WHEN llm_called THEN 'answer' ELSE 'plan' END AS kind,
    CASE WHEN k % 5 <> 0 THEN k * 10 ELSE 0 END + CASE WHEN k % 4 = 0 THEN k ELSE 0 END AS tokens_in,
    CASE WHEN k % 2 = 0 THEN k * 3 ELSE 0 END + CASE WHEN k % 3 = 0 THEN k * 2 ELSE 0 END AS tokens_out,
    CASE WHEN k % 7 = 0 AND k > 0 THEN k * 20 ELSE tokens_in + tokens_out END AS tokens
  FROM log
), ledger AS (
  SELECT day, kind, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
    CAST(sum(tokens) AS BIGINT) AS tokens FROM used WHERE tokens > 0 GROUP BY day, kind
)"""


@query("L9_token_ledger", f"WITH {_LEDGER_SQL} SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM ledger")
def l9(spark, sf_dir):
    return _day(logs.token_ledger(_usage(spark, sf_dir)))


@query("L10_token_report", f"""WITH {_LEDGER_SQL}, today AS (SELECT max(day) AS today FROM ledger)
  SELECT kind, CAST(sum(CASE WHEN day = today THEN tokens ELSE 0 END) AS BIGINT) AS today_tokens,
    CAST(sum(CASE WHEN day = today THEN calls ELSE 0 END) AS BIGINT) AS today_calls,
    CAST(sum(CASE WHEN day >= today - 6 THEN tokens ELSE 0 END) AS BIGINT) AS week_tokens,
    round(sum(CASE WHEN day = today THEN tokens ELSE 0 END) / nullif(sum(CASE WHEN day = today THEN calls ELSE 0 END), 0), 6) AS per_call
  FROM ledger, today GROUP BY kind""")
def l10(spark, sf_dir):
    return logs.token_report(logs.merge_ledgers(logs.token_ledger(_usage(spark, sf_dir))))


# L11 as a walk through every caller's requests: the state is the counts of the running minute and day.
ADMISSION_SQL = """, asked AS (SELECT log_id, caller, ts, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute, CASE WHEN caller % 2 = 1 THEN 60 ELSE 25 END AS most,
    row_number() OVER (PARTITION BY caller, date_trunc('minute', ts) ORDER BY ts, log_id) AS in_minute FROM log),
  judged AS (SELECT *, in_minute <= 10 AND count(*) FILTER (in_minute <= 10) OVER (PARTITION BY caller, day ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) <= most AS admitted FROM asked),
  admission AS (SELECT log_id, caller, admitted, CASE WHEN admitted THEN NULL WHEN coalesce(count(*) FILTER (admitted)
    OVER (PARTITION BY caller, minute ORDER BY ts, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 10 THEN 'minute' ELSE 'day' END AS scope FROM judged)"""


@query("L11_admission", _log_sql(ADMISSION_SQL + " SELECT * FROM admission"))
def l11(spark, sf_dir):
    return logs.admission(_log(spark, sf_dir).withColumn("signed_in", F.col("caller") % 2 == 1)).drop("ts")


# Few callers of the event table ever reach a limit, so here all requests of a user's tenth come from one caller.
_BUSY_SQL = f"{LOG_SQL.split('log AS (', 1)[0]}raw_log AS ({LOG_SQL.split('log AS (', 1)[1]}, log AS (SELECT log_id, ts - INTERVAL 1 SECOND * (epoch(ts)::BIGINT % 3600 - epoch(ts)::BIGINT % 240) AS ts, caller % 10 AS caller FROM raw_log)"


@query("L11_busy_callers", f"WITH {_BUSY_SQL}{ADMISSION_SQL} SELECT * FROM admission")
def l11_busy(spark, sf_dir):
    """Ten callers make all requests, crowded into the first four minutes of each hour."""
    log = _log(spark, sf_dir)
    second = F.unix_micros("ts") / 1_000_000
    whole = F.round(second).cast("long")
    shift = F.make_dt_interval(secs=(whole % 3600 - whole % 240).cast("decimal(18,6)"))
    crowded = log.select("log_id", (F.col("ts") - shift).alias("ts"), (F.col("caller") % 10).alias("caller"))
    return logs.admission(crowded.withColumn("signed_in", F.col("caller") % 2 == 1)).drop("ts")


# The pool's use is counted call by call: a call beyond the day's 300 takes nothing from its minute.
CEILING_SQL = """, granted AS (SELECT log_id, CAST(ts AS DATE) AS day, ts, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, log_id) AS call_of_day FROM log WHERE llm_called),
  paced AS (SELECT log_id, day, call_of_day, call_of_day <= 300 AS allowed, count(*) FILTER (call_of_day <= 300) OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS spent_in_minute FROM granted)"""
_CROWDED_SQL = f"{LOG_SQL.split('log AS (', 1)[0]}plain_log AS ({LOG_SQL.split('log AS (', 1)[1]}, log AS (SELECT * REPLACE (ts - INTERVAL 1 SECOND * (epoch(ts)::BIGINT % 3600 - epoch(ts)::BIGINT % 240) AS ts, caller % 10 AS caller) FROM plain_log)"


def _crowded(log):
    """Requests moved into the first four minutes of their hour, all from ten callers, so that limits are met."""
    whole = F.round(F.unix_micros("ts") / 1_000_000).cast("long")
    shift = F.make_dt_interval(secs=(whole % 3600 - whole % 240).cast("decimal(18,6)"))
    return log.withColumn("ts", F.col("ts") - shift).withColumn("caller", F.col("caller") % 10)


@query("L12_daily_ceiling", f"WITH {_CROWDED_SQL}{CEILING_SQL} SELECT *, allowed AND 6 - spent_in_minute + 1 >= 3 AS may_escalate FROM paced".replace("SELECT *, allowed", "SELECT log_id, strftime(day, '%Y-%m-%d') AS day, call_of_day, allowed, spent_in_minute, allowed"))
def l12(spark, sf_dir):
    return _day(logs.daily_ceiling(_crowded(_log(spark, sf_dir))))


@query("L13_usage_report", f"""WITH {_CROWDED_SQL}{ADMISSION_SQL}{CEILING_SQL}, used AS (SELECT caller, CAST(ts AS DATE) AS day, count(*) FILTER (admitted) AS used, CASE WHEN caller % 2 = 1 THEN 60 ELSE 25 END AS most
    FROM admission JOIN (SELECT log_id, ts FROM log) USING (log_id) GROUP BY ALL UNION ALL SELECT NULL, day, count(*) FILTER (allowed), 300 FROM paced GROUP BY day)
  SELECT caller, strftime(day, '%Y-%m-%d') AS day, used, CAST(most AS BIGINT) AS "limit", CAST(greatest(0, most - used) AS BIGINT) AS remaining FROM used""")
def l13(spark, sf_dir):
    """Odd callers are signed in; requests beyond a limit don't count, and the pool has a row of its own."""
    log = _crowded(_log(spark, sf_dir)).withColumn("signed_in", F.col("caller") % 2 == 1)
    return _day(logs.usage_report(logs.admission(log), log.select("caller", "signed_in").distinct(), logs.daily_ceiling(log)))


@query("L14_cache_lookup", _log_sql(""", entries AS (SELECT CASE WHEN k % 9 = 0 THEN 'e0:' WHEN k % 4 = 0 THEN 'e1:old ' ELSE 'e1:' END || question AS key, min(ts) AS written_at
    FROM log WHERE llm_called GROUP BY ALL),
  found AS (SELECT log_id, max(e.written_at) FILTER (e.key = 'e1:' || question) AS a, max(e.written_at) FILTER (e.key = 'e1:old ' || question) AS b FROM log LEFT JOIN entries e
    ON e.key IN ('e1:' || question, 'e1:old ' || question) AND e.written_at <= ts AND e.written_at > ts - INTERVAL 30 DAY GROUP BY log_id)
  SELECT log_id, strftime(coalesce(a, b), '%Y-%m-%d %H:%M:%S.%f') AS written_at, CASE WHEN a IS NOT NULL THEN 'key' WHEN b IS NOT NULL THEN 'legacy' END AS via, coalesce(a, b) IS NOT NULL AS hit FROM found"""))
def l14(spark, sf_dir):
    """Every ninth question was answered in another epoch, every fourth other one under its legacy key."""
    log = _log(spark, sf_dir)
    under = F.when(F.col("k") % 9 == 0, "e0:").when(F.col("k") % 4 == 0, "e1:old ").otherwise("e1:")
    entries = log.where("llm_called").groupBy(F.concat(under, "question").alias("key")).agg(F.min("ts").alias("written_at"))
    asked = log.select("log_id", "ts", F.concat(F.lit("e1:"), "question").alias("cache_key"), F.concat(F.lit("e1:old "), "question").alias("legacy_key"))
    return _moment(logs.cache_lookup(asked, entries), "written_at")


def _answers(log, old: bool):
    part = log.where("llm_called").where(F.col("k") % 2 == 0 if old else F.col("k") % 3 == 0)
    return part.select(
        F.col("question").alias("key"), F.concat(F.lit("q-"), F.col("log_id").cast("string")).alias("slug"), F.col("ts").alias("created_at"),
        F.when(F.col("k") > 50, "large").otherwise("small").alias("model"), F.round("best_cosine", 4).cast("string").alias("answer"), F.col("ts").alias("updated_at"),
    )


_ANSWERS_SQL = """, answers AS (SELECT question AS key, 'q-' || log_id AS slug, ts AS created_at, CASE WHEN k > 50 THEN 'large' ELSE 'small' END AS model,
    log_id AS answer, ts AS updated_at, k FROM log WHERE llm_called)"""


@query("L15_upsert_answers", _log_sql(_ANSWERS_SQL + """,
  o AS (SELECT * FROM answers WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at, slug) = 1),
  n AS (SELECT * FROM answers WHERE k % 3 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, slug DESC) = 1)
  SELECT coalesce(o.key, n.key) AS key, coalesce(o.slug, n.slug) AS slug, strftime(coalesce(o.created_at, n.created_at), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
    coalesce(o.model, n.model) AS model, coalesce(n.answer, o.answer) AS answer, strftime(coalesce(n.updated_at, o.updated_at), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
  FROM o FULL JOIN n ON o.key = n.key"""))
def l15(spark, sf_dir):
    from pyspark.sql import Window

    log = _log(spark, sf_dir)
    answer = lambda df: df.withColumn("answer", F.substring("slug", 3, 20).cast("long"))
    first = Window.partitionBy("key").orderBy("updated_at", "slug")
    old = answer(_answers(log, True)).withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    made = logs.upsert_answers(old, answer(_answers(log, False)))
    return _moment(made, "created_at", "updated_at")


@query("L16_loggable", _log_sql("SELECT log_id, question FROM log WHERE NOT private"))
def l16(spark, sf_dir):
    return logs.loggable(_log(spark, sf_dir)).select("log_id", "question")
