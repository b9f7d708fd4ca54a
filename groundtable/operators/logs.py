"""Analytics over the question log: digests, quotas, caches and token use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogParams:
    """Windows, thresholds and quotas of the usage reports."""

    digest_days: int = 7
    weak_cosine: float = 0.68
    alarm_share: float = 0.30
    per_minute: int = 10
    per_day: int = 25
    per_day_signed_in: int = 60
    daily_calls: int = 300
    calls_per_minute: int = 6
    spare_calls: int = 3
    cache_days: int = 30


DEFAULTS = LogParams()


def latest(log: DataFrame) -> DataFrame:
    return log.agg(F.max("ts").alias("now"))


def within_days(log: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the log's newest row; that one row is joined by broadcast."""
    return log.join(F.broadcast(latest(log)), F.col("ts") > F.col("now") - F.make_interval(days=F.lit(days))).drop("now")


def count_true(flag: str) -> Column:
    return F.sum(F.col(flag).cast("long"))


def digest_totals(log: DataFrame, days: int = DEFAULTS.digest_days) -> DataFrame:
    """L1: how many questions were refused, cached, sent on or degraded; mean latency; whole percentages."""
    totals = within_days(log, days).agg(
        F.count("*").alias("questions"),
        count_true("below_threshold").alias("refused"),
        count_true("cache_hit").alias("cached"),
        count_true("llm_called").alias("llm"),
        count_true("degraded").alias("degraded"),
        F.round(F.avg("latency_ms")).alias("mean_ms"),
    )
    share = lambda c: F.floor(100.0 * F.col(c) / F.col("questions") + 0.5).cast("long")
    return totals.withColumn("refused_pct", share("refused")).withColumn("cached_pct", share("cached"))


def refused_top(log: DataFrame, n: int = 12) -> DataFrame:
    """L2: the questions refused most often."""
    return (
        log.where("below_threshold").groupBy(F.sha2("question", 256).alias("question_hash"))
        .agg(F.count("*").alias("n"), F.min("question").alias("question")).drop("question_hash")
        .orderBy(F.desc("n"), "question").limit(n)
    )


def weak_retrieval(log: DataFrame, n: int = 8, below: float = DEFAULTS.weak_cosine) -> DataFrame:
    """L3: answered questions with the lowest best cosine."""
    weak = log.where(F.col("llm_called") & (F.col("best_cosine") < below))
    return weak.orderBy("best_cosine", "log_id").limit(n).select("log_id", "question", F.round("best_cosine", 3).alias("cos"))


def feedback_reasons(feedback: DataFrame) -> DataFrame:
    """L4: verdicts, and reasons given for negative ones."""
    return feedback.groupBy("verdict", F.coalesce("reason", F.lit("(none given)")).alias("reason")).agg(F.count("*").alias("n"))


def latest_negative(feedback: DataFrame, n: int = 6) -> DataFrame:
    """L4: the newest negative verdicts."""
    return feedback.where("verdict = 'down'").orderBy(F.desc("ts"), F.desc("feedback_id")).limit(n).select("feedback_id", "question", "reason")


def citation_quality(log: DataFrame, alarm: float = DEFAULTS.alarm_share) -> DataFrame:
    """Weak citations among those checked."""
    sums = log.where("cite_checked IS NOT NULL").agg(
        F.sum("cite_checked").alias("checked"), F.sum("cite_weak").alias("weak"), F.count("*").alias("answers")
    )
    return sums.withColumn("weak_share", F.round(F.col("weak") / F.col("checked"), 6)).withColumn("alarm", F.col("weak") / F.col("checked") > alarm)


def daily_activity(log: DataFrame, days: int = 14) -> DataFrame:
    """Questions and cache hits of the newest days."""
    by_day = log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("questions"), count_true("cache_hit").alias("cache_hits"))
    return by_day.orderBy(F.desc("day")).limit(days)


def distinct_askers(log: DataFrame) -> DataFrame:
    """Callers per day."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("caller").alias("askers"))


def token_ledger(usage: DataFrame) -> DataFrame:
    """Token counts summed into (day, kind); rows without any count are left out.

    ``usage`` has ts, kind and the nullable counts prompt, tool, thought, answer, total.
    """
    part = lambda *names: sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    used = usage.select(
        F.to_date("ts").alias("day"), "kind", part("prompt", "tool").alias("tokens_in"), part("answer", "thought").alias("tokens_out"),
        F.coalesce(F.when(F.col("total") > 0, F.col("total")), part("prompt", "tool", "answer", "thought")).alias("tokens"),
    ).where("tokens > 0")
    return used.groupBy("day", "kind").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("tokens").alias("tokens")
    )


def merge_ledgers(*ledgers: DataFrame) -> DataFrame:
    """Ledgers of several runs folded into one."""
    whole = ledgers[0]
    for other in ledgers[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("day", "kind").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens_in", "tokens_out", "tokens")])


def token_report(ledger: DataFrame) -> DataFrame:
    """The newest day's tokens by kind, tokens per call, and the sum of seven days."""
    newest = ledger.agg(F.max("day").alias("today"))
    return (
        ledger.join(F.broadcast(newest)).groupBy("kind")
        .agg(
            F.sum(F.when(F.col("day") == F.col("today"), F.col("tokens")).otherwise(0)).alias("today_tokens"),
            F.sum(F.when(F.col("day") == F.col("today"), F.col("calls")).otherwise(0)).alias("today_calls"),
            F.sum(F.when(F.col("day") >= F.date_sub("today", 6), F.col("tokens")).otherwise(0)).alias("week_tokens"),
        )
        .withColumn("per_call", F.round(F.col("today_tokens") / F.nullif("today_calls", F.lit(0)), 6))
    )


def admission(requests: DataFrame, params: LogParams = DEFAULTS) -> DataFrame:
    """(log_id, caller, ts, admitted, scope): a caller's requests within the limits of minute and day.

    Only admitted work counts, and the minute is looked at first.  Up to the day's limit a minute admits
    its first ``per_minute`` requests, so these are the day's candidates, and of the candidates the first
    ones up to the limit are admitted.  A minute bounds the candidates of a day, so the second window
    stays small however busy a caller is.  ``signed_in`` is a property of the caller.
    """
    keyed = requests.select("log_id", "caller", "ts", "signed_in", F.to_date("ts").alias("day"), F.date_trunc("minute", "ts").alias("minute"))
    ranked = keyed.withColumn("in_minute", F.row_number().over(Window.partitionBy("caller", "minute").orderBy("ts", "log_id")))
    candidate = F.col("in_minute") <= params.per_minute
    limit = F.when(F.col("signed_in"), params.per_day_signed_in).otherwise(params.per_day)
    counted = ranked.where(candidate).withColumn("in_day", F.row_number().over(Window.partitionBy("caller", "day").orderBy("ts", "log_id")))
    judged = counted.withColumn("admitted", F.col("in_day") <= limit)
    full = judged.groupBy("caller", "minute").agg(F.count_if("admitted").alias("n"))
    columns = ["log_id", "caller", "ts", "admitted", "scope"]
    first = judged.withColumn("scope", F.when(~F.col("admitted"), "day")).select(*columns)
    beyond = ranked.where(~candidate).join(full, ["caller", "minute"])
    scope = F.when(F.col("n") >= params.per_minute, "minute").otherwise("day")
    return first.unionByName(beyond.withColumn("admitted", F.lit(False)).withColumn("scope", scope).select(*columns))


def daily_ceiling(log: DataFrame, params: LogParams = DEFAULTS) -> DataFrame:
    """(log_id, day, call_of_day, allowed, spent_in_minute, may_escalate) of model calls.

    The first ``daily_calls`` of a day are allowed; a call that is not is degraded and uses up neither day nor
    minute.  ``spent_in_minute`` counts the minute's allowed calls up to this one, itself included if allowed; an
    expensive second pass is made only if before it the minute has ``spare_calls`` left, the answer's own among them.

    Calls are numbered within their minute, and the minutes' counts are summed over the day, so no task
    gets a whole day of calls.
    """
    day, minute = F.to_date("ts").alias("day"), F.date_trunc("minute", "ts").alias("minute")
    calls = log.where("llm_called").select("log_id", "ts", day, minute)
    numbered = calls.withColumn("in_minute", F.row_number().over(Window.partitionBy("minute").orderBy("ts", "log_id")).cast("long"))
    counts = calls.groupBy("day", "minute").agg(F.count("*").alias("n"))
    before = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("minute", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    spent = F.least("in_minute", F.greatest(F.lit(params.daily_calls) - F.col("before"), F.lit(0)))
    return (
        numbered.join(offsets, "minute").select("log_id", "day", (F.col("before") + F.col("in_minute")).alias("call_of_day"), spent.cast("long").alias("spent_in_minute"))
        .withColumn("allowed", F.col("call_of_day") <= params.daily_calls)
        .withColumn("may_escalate", F.col("allowed") & (params.calls_per_minute - F.col("spent_in_minute") + 1 >= params.spare_calls))
    )


def usage_report(admitted: DataFrame, callers: DataFrame, calls: DataFrame, params: LogParams = DEFAULTS) -> DataFrame:
    """(caller, day, used, limit, remaining): what each caller has used of a day's limit, and the pool of all model calls as a null caller.

    ``admitted`` is L11's result, of which only admitted requests count, ``callers`` says which callers are
    signed in, and ``calls`` is L12's result, of which only allowed calls count.  Callers and days with
    refused requests alone have used nothing.
    """
    own = admitted.groupBy("caller", F.to_date("ts").alias("day")).agg(F.count_if("admitted").alias("used"))
    signed_in = F.coalesce("signed_in", F.lit(False))
    by_caller = own.join(callers.select("caller", "signed_in"), "caller", "left").select(
        "caller", "day", "used", F.when(signed_in, params.per_day_signed_in).otherwise(params.per_day).cast("long").alias("limit")
    )
    pool = calls.groupBy("day").agg(F.count_if("allowed").alias("used"))
    pooled = pool.select(F.lit(None).cast(dict(admitted.dtypes)["caller"]).alias("caller"), "day", "used", F.lit(params.daily_calls).cast("long").alias("limit"))
    return by_caller.unionByName(pooled).withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("limit") - F.col("used")))


def cache_entries(log: DataFrame) -> DataFrame:
    """The first time each question was answered."""
    return log.where("llm_called").groupBy("question").agg(F.min("ts").alias("written_at"))


def cache_lookup(asked: DataFrame, entries: DataFrame, days: int = DEFAULTS.cache_days) -> DataFrame:
    """(log_id, written_at, via, hit): the newest entry under a question's key, else under its legacy key,
    written within ``days`` before it was asked.

    ``asked`` is (log_id, ts, cache_key, legacy_key), ``entries`` (key, written_at); keys begin with the
    corpus epoch, so entries of another epoch never match.
    """
    keys = F.explode(F.array(F.struct(F.lit("key").alias("via"), F.col("cache_key").alias("key")), F.struct(F.lit("legacy").alias("via"), F.col("legacy_key").alias("key"))))
    sought = asked.select("log_id", "ts", keys.alias("k")).select("log_id", "ts", "k.via", "k.key")
    fresh = (F.col("written_at") <= F.col("ts")) & (F.col("written_at") > F.col("ts") - F.make_interval(days=F.lit(days)))
    newest = lambda via: F.max(F.when((F.col("via") == via) & fresh, F.col("written_at"))).alias(via)
    found = sought.join(entries, "key", "left").groupBy("log_id").agg(newest("key"), newest("legacy"))
    via = F.when(F.col("key").isNotNull(), "key").when(F.col("legacy").isNotNull(), "legacy")
    return found.select("log_id", F.coalesce("key", "legacy").alias("written_at"), via.alias("via"), via.isNotNull().alias("hit"))


def upsert_answers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per key; identity and creation of an existing row stay, answer fields are replaced.

    Both have (key, slug, created_at, model, answer, updated_at).
    """
    order = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("slug"))
    last = new.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    o, n = old.alias("o"), last.alias("n")
    kept = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("slug", "created_at", "model")]
    replaced = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("answer", "updated_at")]
    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(F.coalesce("o.key", "n.key").alias("key"), *kept, *replaced)


def loggable(log: DataFrame) -> DataFrame:
    """Rows asked with personal context are neither cached nor logged."""
    return log.where(~F.coalesce(F.col("private"), F.lit(False)))


def section_summary(chunks: DataFrame) -> DataFrame:
    """Per source and page title how much text there is, in page order; games are told by their title."""
    return chunks.groupBy("source_id", "page_title").agg(
        F.count("*").alias("sections"), F.sum("char_len").alias("chars"), F.min("ordinal").alias("first_ordinal"),
        F.bool_or(F.col("page_title").rlike(r"(?i)\b(game|season)\b")).alias("game_published"),
    )
