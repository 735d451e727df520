"""Key entitlement, interaction state and the admission of a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kbspark import constants as K
from kbspark.functions import rules as R
from kbspark.functions import text as X
from kbspark.operators import limits, usage
from kbspark.session import cut_lineage


def required_scope(endpoint: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, scope in K.ENDPOINT_SCOPES.items():
        chain = F.when(endpoint == name, scope).otherwise(chain)
    return chain


def entitlement(log: DataFrame, api_keys: DataFrame) -> DataFrame:
    """The log with ``scope_code`` (401 unknown key, 403 missing scope, else
    200), ``status_code`` (403 for a disabled key) and the key's status."""
    registry = api_keys.select("api_key", "scopes", F.col("status").alias("key_status"))
    need = required_scope(F.col("endpoint"))
    scope_code = F.when(F.col("scopes").isNull(), 401).when(
        need.isNotNull() & ~F.array_contains("scopes", need), 403).otherwise(200)
    status_code = F.when(F.col("key_status").isin(*K.ADMITTED_KEY_STATUS), 200).otherwise(403)
    return log.join(registry, "api_key", "left").withColumns(
        {"scope_code": scope_code, "status_code": status_code}).drop("scopes")


def state_status() -> Column:
    """valid, expired or unknown: a state is known from ``created_at`` on and valid until ``expires_at``."""
    return F.when(
        F.col("expires_at").isNull() | (F.col("requested_at") < F.col("created_at")), "unknown").when(
        F.col("expires_at") < F.col("requested_at"), "expired").otherwise("valid")


def lookup(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests with ``state_status`` and the state's columns."""
    return requests.join(states, ["interaction_id", "tenant_id"], "left").withColumn("state_status", state_status())


def audit_rows(looked_up: DataFrame, masked=("purpose", "key_points", "ops_query")) -> DataFrame:
    """Audit records of the valid lookups: personal data masked, outcome set."""
    valid = looked_up.filter("state_status = 'valid'")
    present = [c for c in masked if c in valid.columns]
    return valid.withColumns({c: X.mask_pii(F.col(c)) for c in present}).withColumn("decision_outcome", F.lit("allowed"))


# The columns of the interaction log.
AUDIT_SCHEMA = (
    "interaction_id string, tenant_id string, session_id string, workflow_type string, purpose string, key_points string, "
    "ops_query string, intent string, intent_model_used boolean, intent_confidence double, retrieval_confidence double, "
    "decision_outcome string, generated_response string")


def audit_log(looked_up: DataFrame) -> DataFrame:
    """The interaction log's thirteen columns of every valid lookup: personal data
    masked, columns that the lookup does not have null, others left out."""
    rows = audit_rows(looked_up)
    return rows.select(*[
        (F.col(f"`{name}`") if name in rows.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in (c.split() for c in AUDIT_SCHEMA.split(", "))
    ])


def counted_usage(replayed: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """Monthly counters of a replayed log. A call that the cap on calls refused counts as a request, not as a call."""
    called = F.col("is_llm") & (F.col("outcome") == "admitted")
    return usage.monthly_usage(replayed.filter("counted").withColumn("is_llm", called), keys)


def admission_replay(
    log: DataFrame, api_keys: DataFrame, rate_limits: dict, abuse_limits: dict, request_cap: int, llm_cap: int,
    rate_seconds: int = K.RATE_WINDOW_SECONDS, abuse_seconds: int = K.ABUSE_WINDOW_SECONDS,
    skew_seconds: int = K.MAX_SKEW_SECONDS, input_ok: Column | None = None,
) -> DataFrame:
    """event_id, ``outcome`` and ``counted`` of every request, as the gates in server order
    leave it: key and scope, rate limit, clock skew, key status, input, abuse
    limit, monthly caps. Each gate sees only what the ones before let through;
    the rate limit counts a request before its time stamp is checked. Usage counts
    what was admitted and the one call at which the cap on calls disabled a key."""
    ok = F.lit(True) if input_ok is None else input_ok
    first = entitlement(log, api_keys)
    outcome = F.when(F.col("scope_code") == 401, "unknown_key").when(F.col("scope_code") == 403, "missing_scope")
    first = cut_lineage(first.withColumn("outcome", outcome), "entitled")
    order = ["us", "event_id"]

    entered = first.filter("outcome is null")
    rated = limits.rate_limit(entered, rate_limits, rate_seconds).select("event_id", F.col("accepted").alias("rate_ok"))
    second = entered.join(rated, "event_id").withColumn(
        "outcome",
        F.when(~F.col("rate_ok"), "rate_limited")
        .when(~R.within_skew(F.col("ts"), F.col("seen_ts"), skew_seconds), "stale")
        .when(F.col("status_code") != 200, "disabled_key")
        .when(~F.coalesce(ok, F.lit(False)), "bad_input"),
    )
    second = cut_lineage(second, "rated")

    clean = second.filter("outcome is null")
    abuse = limits.abuse_limit(clean, abuse_limits, abuse_seconds).select("event_id", F.col("accepted").alias("abuse_ok"))
    third = cut_lineage(clean.join(abuse, "event_id").withColumn(
        "outcome", F.when(~F.col("abuse_ok"), "abuse_detected")), "checked")

    counted = usage.autoblock(third.filter("outcome is null").drop("outcome"), request_cap, llm_cap)
    fourth = counted.withColumn(
        "outcome", F.when(F.col("allowed"), "admitted").otherwise(F.col("block_reason")))
    given = [*order, "ts", "api_key", "tenant_id", "endpoint", "is_llm", "outcome"]
    decided = [f.filter("outcome is not null").select(*given, F.lit(False).alias("counted")) for f in (first, second, third)]
    out = fourth.select(*given, "counted")
    for part in decided:
        out = out.unionByName(part)
    return out
