"""Usage totals, monthly quotas and monitoring alerts over a request log.

Log columns: event_id, ts, us (microseconds), api_key, tenant_id, is_llm (the
request counts as use of a model), is_capped (it counts towards the cap on calls)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark import constants as K
from kbspark.session import cut_lineage

DAY_US = 86_400_000_000


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_usage(log: DataFrame, keys=("tenant_id",), cost: int = K.COST_PER_LLM_CALL) -> DataFrame:
    calls = F.count_if(F.col("is_llm"))
    return log.groupBy(*keys, month_of(F.col("ts")).alias("month")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        calls.alias("llm_calls"),
        (calls * cost).alias("estimated_ai_cost"),
    )


def daily_usage(log: DataFrame, keys=("tenant_id",)) -> DataFrame:
    return log.filter("is_llm").groupBy(*keys, F.to_date("ts").alias("usage_date")).agg(
        F.count(F.lit(1)).alias("llm_calls"))


def usage_increments(log: DataFrame, keys=("tenant_id",), cost: int = K.COST_PER_LLM_CALL) -> DataFrame:
    """Counters of each key and day: sums of them over parts of a log are those of
    the whole, and months and peak days follow from them."""
    calls = F.count_if(F.col("is_llm"))
    return log.groupBy(*keys, month_of(F.col("ts")).alias("month"), F.to_date("ts").alias("usage_date")).agg(
        F.count(F.lit(1)).alias("total_requests"), calls.alias("llm_calls"), (calls * cost).alias("estimated_ai_cost"))


def usage_totals(log: DataFrame, keys=("tenant_id",), cost: int = K.COST_PER_LLM_CALL) -> DataFrame:
    """(keys, month, usage_date, of_month, total_requests, llm_calls, estimated_ai_cost, first_us) of
    every day and, without a date, every month: one pass over the log sums days, and both
    levels are grouping sets of those sums. The rows, few per key, are stored for all who read them."""
    day = [*keys, "month", "usage_date"]
    days = log.groupBy(*keys, month_of(F.col("ts")).alias("month"), F.to_date("ts").alias("usage_date")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("is_llm")).alias("calls"), F.min("us").alias("first"))
    totals = days.groupingSets([[F.col(c) for c in day], [F.col(c) for c in day[:-1]]], *[F.col(c) for c in day]).agg(
        (F.grouping("usage_date") == 1).alias("of_month"), F.sum("requests").alias("total_requests"),
        F.sum("calls").alias("llm_calls"), (F.sum("calls") * cost).alias("estimated_ai_cost"), F.min("first").alias("first_us"))
    return cut_lineage(totals, "usage-totals")


def peak_day(daily: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """Day of each month with most calls, the earliest on a tie."""
    rank = F.struct(F.col("llm_calls"), -F.unix_date("usage_date"))
    return daily.groupBy(*keys, month_of(F.col("usage_date")).alias("month")).agg(
        F.max_by("usage_date", rank).alias("peak_day"))


def usage_report(log: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """Monthly totals with their peak day."""
    return monthly_usage(log, keys).join(peak_day(daily_usage(log, keys), keys), [*keys, "month"], "left")


# -- quotas ---------------------------------------------------------------

ROLLUP_SECONDS = 60


def _crossing(log: DataFrame, keys, cap: int, reason: str) -> DataFrame:
    """First request of each key and month beyond ``cap``: keys, month, at
    (time and id), reason.

    Counts per minute are summed first, so the running total runs over minutes
    and requests are numbered only inside the one minute that crosses."""
    minute = F.floor(F.col("us") / (ROLLUP_SECONDS * 1_000_000))
    group = [*keys, "month"]
    per_minute = log.groupBy(*group, minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("minute"))
    hit = per_minute.withColumn("upto", upto).filter((F.col("upto") > cap) & (F.col("upto") - F.col("n") <= cap))
    hit = hit.select(*group, "minute", (F.col("upto") - F.col("n")).alias("before"))
    inside = log.withColumn("minute", minute).join(hit, [*group, "minute"])
    order = Window.partitionBy(*group).orderBy("us", "event_id")
    return inside.withColumn("place", F.col("before") + F.row_number().over(order)).filter(
        F.col("place") == cap + 1
    ).select(*group, F.struct("us", "event_id").alias("at"), F.lit(reason).alias("reason"))


def blocks(
    log: DataFrame, request_cap: int = K.MAX_REQUESTS_PER_MONTH, llm_cap: int = K.MAX_LLM_CALLS_PER_MONTH,
    keys=("api_key",),
) -> DataFrame:
    """When and why each key was disabled in a month. Counting stops there, so
    the earlier crossing decides; on one row the request cap comes first."""
    dated = log.withColumn("month", month_of(F.col("ts"))).select(*keys, "month", "us", "event_id", "is_capped")
    both = _crossing(dated, keys, request_cap, K.REQUEST_CAP_REASON).unionByName(
        _crossing(dated.filter("is_capped"), keys, llm_cap, K.LLM_CAP_REASON))
    first = F.min_by("reason", F.struct("at", (F.col("reason") != K.REQUEST_CAP_REASON).alias("later")))
    return both.groupBy(*keys, "month").agg(F.min("at").alias("blocked_at"), first.alias("reason"))


def autoblock(log: DataFrame, request_cap: int, llm_cap: int, keys=("api_key",)) -> DataFrame:
    """The log with ``allowed``, ``block_reason`` and ``counted`` per request. Usage
    is written between the two caps, so the call that crosses the cap on calls is counted."""
    when = blocks(log, request_cap, llm_cap, keys)
    dated = log.withColumn("month", month_of(F.col("ts")))
    pos = F.struct("us", "event_id")
    late = F.coalesce(pos >= F.col("blocked_at"), F.lit(False))
    refused_call = F.coalesce((pos == F.col("blocked_at")) & (F.col("reason") == K.LLM_CAP_REASON), F.lit(False))
    return dated.join(when, [*keys, "month"], "left").withColumns({
        "allowed": ~late, "block_reason": F.when(late, F.col("reason")).otherwise(""), "counted": ~late | refused_call,
    }).drop("blocked_at", "reason")


def quota_counters(log: DataFrame, request_cap: int, llm_cap: int, keys=("api_key",)) -> DataFrame:
    """State of each key and month: counts up to the block, disabled, reason.
    The request that crossed the request cap made no call."""
    when = blocks(log, request_cap, llm_cap, keys)
    dated = log.withColumn("month", month_of(F.col("ts"))).join(when, [*keys, "month"], "left")
    pos = F.struct("us", "event_id")
    counted = F.col("blocked_at").isNull() | (pos <= F.col("blocked_at"))
    called = counted & F.col("is_capped") & ~F.coalesce(
        (pos == F.col("blocked_at")) & (F.col("reason") == K.REQUEST_CAP_REASON), F.lit(False))
    return dated.groupBy(*keys, "month").agg(
        F.count_if(counted).alias("request_count"),
        F.count_if(called).alias("llm_call_count"),
        F.max(F.col("blocked_at").isNotNull()).alias("disabled"),
        F.coalesce(F.max("reason"), F.lit("")).alias("disabled_reason"),
    )


# -- alerts ---------------------------------------------------------------

def _recent_days(daily: DataFrame, keys) -> DataFrame:
    """Present days of each month, newest numbered 1."""
    dated = daily.withColumn("month", month_of(F.col("usage_date")))
    newest = Window.partitionBy(*keys, "month").orderBy(F.desc("usage_date"))
    return dated.withColumn("age", F.row_number().over(newest))


def alert_daily_spike(daily: DataFrame, keys=("tenant_id",), ratio: float = K.SPIKE_RATIO) -> DataFrame:
    last = _recent_days(daily, keys).filter("age <= 2").groupBy(*keys, "month").agg(
        F.max(F.when(F.col("age") == 1, F.col("llm_calls"))).alias("today"),
        F.max(F.when(F.col("age") == 2, F.col("llm_calls"))).alias("yesterday"))
    return last.filter(F.col("today") > ratio * F.col("yesterday")).select(
        *keys, "month", F.format_string("DAILY_SPIKE: %d vs %d", "today", "yesterday").alias("message"))


def alert_sustained_growth(
    daily: DataFrame, keys=("tenant_id",), ratio: float = K.GROWTH_RATIO, days: int = K.GROWTH_DAYS
) -> DataFrame:
    calls, age = F.col("llm_calls"), F.col("age")
    means = _recent_days(daily, keys).filter(age <= 2 * days).groupBy(*keys, "month").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.when(age <= days, calls)) / days).alias("last"),
        (F.sum(F.when(age > days, calls)) / days).alias("prev"))
    return means.filter((F.col("n") == 2 * days) & (F.col("last") >= ratio * F.col("prev"))).select(
        *keys, "month", F.format_string("SUSTAINED_GROWTH: %.1f vs %.1f", "last", "prev").alias("message"))


def alert_fast_burn(
    log: DataFrame, now: Column, keys=("tenant_id",), expected_calls: int = K.EXPECTED_MONTHLY_LLM_CALLS
) -> DataFrame:
    """Calls already at 40 % of what the month should bring in its first quarter."""
    use = log.groupBy(*keys, month_of(F.col("ts")).alias("month")).agg(
        F.min("us").alias("first_us"), F.count_if(F.col("is_llm")).alias("llm_calls"))
    return _fast_burn(use, now, keys, expected_calls)


def _fast_burn(use: DataFrame, now: Column, keys, expected_calls: int) -> DataFrame:
    """The same from (keys, month, first_us, llm_calls)."""
    use = use.withColumn("start", F.unix_micros(F.to_timestamp("month", "yyyy-MM")))
    days_in_month = F.day(F.last_day(F.timestamp_micros("start").cast("date")))
    last_midnight = F.col("start") + (days_in_month - 1).cast("long") * DAY_US
    burn_start = F.greatest("first_us", "start")
    passed = F.floor((F.unix_micros(now) - burn_start) / DAY_US) + 1
    window = F.floor((last_midnight - burn_start) / DAY_US) + 1
    expected = F.lit(float(expected_calls)) * (window / days_in_month)
    return use.withColumn("passed", passed).filter(
        (F.col("llm_calls") >= K.BURN_SHARE * expected) & (F.col("passed") <= K.BURN_TIME_SHARE * window)
    ).select(*keys, "month", F.format_string("FAST_BURN: %d calls in %d days", "llm_calls", "passed").alias("message"))


def alert_cap_proximity(
    monthly: DataFrame, keys=("tenant_id",), llm_cap: int = K.MAX_LLM_CALLS_PER_MONTH, share: float = K.PROXIMITY_SHARE
) -> DataFrame:
    return monthly.filter(F.col("llm_calls") >= share * llm_cap).select(
        *keys, "month", F.format_string("AUTO_BLOCK_PROXIMITY: %d", "llm_calls").alias("message"))


def monitoring_report(
    log: DataFrame, now: Column, keys=("tenant_id",), spike: float = K.SPIKE_RATIO, growth: float = K.GROWTH_RATIO,
    expected_calls: int = K.EXPECTED_MONTHLY_LLM_CALLS, llm_cap: int = K.MAX_LLM_CALLS_PER_MONTH,
) -> DataFrame:
    """One row per firing rule, in rule order. The log is read once."""
    return _report(usage_totals(log, keys), now, keys, spike, growth, expected_calls, llm_cap)


def _report(totals: DataFrame, now: Column, keys, spike: float, growth: float, expected_calls: int, llm_cap: int) -> DataFrame:
    monthly = totals.filter("of_month")
    daily = totals.filter("not of_month and llm_calls > 0").select(*keys, "usage_date", "llm_calls")
    rules = [
        alert_daily_spike(daily, keys, spike),
        _fast_burn(monthly, now, keys, expected_calls),
        alert_sustained_growth(daily, keys, growth),
        alert_cap_proximity(monthly, keys, llm_cap),
    ]
    return reduce(DataFrame.unionByName, [r.withColumn("rule", F.lit(i)) for i, r in enumerate(rules, start=1)])


def usage_and_alerts(
    log: DataFrame, now: Column, keys=("tenant_id",), spike: float = K.SPIKE_RATIO, growth: float = K.GROWTH_RATIO,
    expected_calls: int = K.EXPECTED_MONTHLY_LLM_CALLS, llm_cap: int = K.MAX_LLM_CALLS_PER_MONTH,
) -> DataFrame:
    """Monthly totals with peak day and the alerts that fire, in rule order; all from one pass over the log."""
    totals = usage_totals(log, keys)
    firing = F.array_sort(F.collect_list(F.struct("rule", "message")))  # at most one per rule
    alerts = _report(totals, now, keys, spike, growth, expected_calls, llm_cap).groupBy(*keys, "month").agg(firing.alias("f")).select(
        *keys, "month", F.array_join("f.message", "; ").alias("alerts"))
    peaks = peak_day(totals.filter("not of_month and llm_calls > 0"), keys)
    monthly = totals.filter("of_month").select(*keys, "month", "total_requests", "llm_calls", "estimated_ai_cost")
    return monthly.join(peaks, [*keys, "month"], "left").join(alerts, [*keys, "month"], "left").withColumn(
        "alerts", F.coalesce("alerts", F.lit("")))
