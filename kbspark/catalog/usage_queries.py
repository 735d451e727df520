"""Usage, quota, alert, limit and access queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kbspark import constants as K
from kbspark.catalog import fixtures as X
from kbspark.catalog import sqlkit as Q
from kbspark.catalog.fixtures import sql
from kbspark.functions import rules
from kbspark.operators import access, limits, usage
from kbspark.session import work_dir
from kbspark.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict = {}

# Scaled down so that every outcome occurs in the given tables.
REQUEST_CAP, LLM_CAP = 240, 50
SPIKE, GROWTH, EXPECTED, PROXIMITY_CAP = 1.2, 1.05, 300, 540
NOW = "2024-02-05 00:00:00"
USERS = ("user_id",)


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def shifted(spark, sf_dir):
    return X.shift_days(X.request_log(spark, sf_dir), 15)


USAGE = {
    "monthly": """SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) AS total_requests,
        count(*) FILTER (WHERE is_llm) AS llm_calls, count(*) FILTER (WHERE is_llm) * 5 AS estimated_ai_cost
        FROM shifted_log GROUP BY ALL""",
    "daily": """SELECT tenant_id, CAST(ts AS DATE) AS usage_date, count(*) AS llm_calls FROM shifted_log WHERE is_llm GROUP BY ALL""",
    "peaks": """SELECT tenant_id, strftime(usage_date, '%Y-%m') AS month, CAST(usage_date AS VARCHAR) AS peak_day FROM daily
        QUALIFY row_number() OVER (PARTITION BY tenant_id, strftime(usage_date, '%Y-%m') ORDER BY llm_calls DESC, usage_date) = 1""",
    "aged": """SELECT *, strftime(usage_date, '%Y-%m') AS month,
        row_number() OVER (PARTITION BY tenant_id, strftime(usage_date, '%Y-%m') ORDER BY usage_date DESC) AS age FROM daily""",
    "spikes": f"""SELECT tenant_id, month, 'DAILY_SPIKE: ' || a || ' vs ' || b AS message FROM
        (SELECT tenant_id, month, max(llm_calls) FILTER (WHERE age = 1) AS a, max(llm_calls) FILTER (WHERE age = 2) AS b FROM aged GROUP BY ALL)
        WHERE a > {SPIKE} * b""",
    "growth": f"""SELECT tenant_id, month, 'SUSTAINED_GROWTH: ' || printf('%.1f', a) || ' vs ' || printf('%.1f', b) AS message FROM
        (SELECT tenant_id, month, sum(llm_calls) FILTER (WHERE age <= 7) / 7 AS a, sum(llm_calls) FILTER (WHERE age > 7) / 7 AS b, count(*) AS n
         FROM aged WHERE age <= 14 GROUP BY ALL) WHERE n = 14 AND a >= {GROWTH} * b""",
    "burns": f"""SELECT tenant_id, month, 'FAST_BURN: ' || llm_calls || ' calls in ' || passed || ' days' AS message FROM
        (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - greatest(f, s)) / 86400000000) AS BIGINT) + 1 AS passed,
            CAST(floor((s + (dim - 1) * 86400000000 - greatest(f, s)) / 86400000000) AS BIGINT) + 1 AS win FROM
            (SELECT tenant_id, strftime(ts, '%Y-%m') AS month, epoch_us(date_trunc('month', min(ts))::TIMESTAMP) AS s, min(us) AS f,
                day(last_day(min(ts))) AS dim, count(*) FILTER (WHERE is_llm) AS llm_calls FROM shifted_log GROUP BY tenant_id, month))
        WHERE llm_calls >= 0.4::DOUBLE * ({float(EXPECTED)}::DOUBLE * (win / dim)) AND passed <= 0.25::DOUBLE * win""",
    "near_cap": f"""SELECT tenant_id, month, 'AUTO_BLOCK_PROXIMITY: ' || llm_calls AS message FROM monthly WHERE llm_calls >= 0.75 * {PROXIMITY_CAP}""",
    "report": """SELECT *, 1 AS rule FROM spikes UNION ALL SELECT *, 2 FROM burns UNION ALL SELECT *, 3 FROM growth
        UNION ALL SELECT *, 4 FROM near_cap""",
}


def usql(body: str) -> str:
    return sql(body, **USAGE)


def day_text(df, name):
    return df.withColumn(name, F.col(name).cast("string"))


@query("usage_monthly", usql("SELECT * FROM monthly"))
def usage_monthly(spark, sf_dir):
    return usage.monthly_usage(shifted(spark, sf_dir))


@query("usage_daily", usql("SELECT tenant_id, CAST(usage_date AS VARCHAR) AS usage_date, llm_calls FROM daily"))
def usage_daily(spark, sf_dir):
    return day_text(usage.daily_usage(shifted(spark, sf_dir)), "usage_date")


@query("usage_peak_day", usql("SELECT * FROM peaks"))
def usage_peak_day(spark, sf_dir):
    return day_text(usage.peak_day(usage.daily_usage(shifted(spark, sf_dir))), "peak_day")


BLOCKS = {
    "counted": """SELECT *, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY api_key, strftime(ts, '%Y-%m') ORDER BY us, event_id) AS rn,
        CASE WHEN is_capped THEN row_number() OVER (PARTITION BY api_key, strftime(ts, '%Y-%m'), is_capped ORDER BY us, event_id) END AS ln FROM shifted_log""",
    "blocked": f"""SELECT api_key, month, min(rn) AS stop_rn, arg_min(reason, rn * 2 + late) AS reason FROM
        (SELECT api_key, month, rn, 0 AS late, '{K.REQUEST_CAP_REASON}' AS reason FROM counted WHERE rn = {REQUEST_CAP + 1}
         UNION ALL SELECT api_key, month, rn, 1, '{K.LLM_CAP_REASON}' FROM counted WHERE ln = {LLM_CAP + 1}) GROUP BY ALL""",
}


@query("cap_autoblock", sql("""SELECT event_id, c.api_key, c.month, rn < coalesce(stop_rn, 9e15) AS allowed,
    CASE WHEN rn >= stop_rn THEN reason ELSE '' END AS block_reason FROM counted c LEFT JOIN blocked b ON c.api_key = b.api_key AND c.month = b.month""", **BLOCKS))
def cap_autoblock(spark, sf_dir):
    return usage.autoblock(shifted(spark, sf_dir), REQUEST_CAP, LLM_CAP).select(
        "event_id", "api_key", "month", "allowed", "block_reason")


@query("quota_counters", sql(f"""SELECT c.api_key, c.month, count(*) FILTER (WHERE rn <= coalesce(stop_rn, 9e15)) AS request_count,
    count(*) FILTER (WHERE is_capped AND rn <= coalesce(stop_rn, 9e15) AND NOT (rn = coalesce(stop_rn, 9e15) AND reason = '{K.REQUEST_CAP_REASON}')) AS llm_call_count,
    max(stop_rn) IS NOT NULL AS disabled, coalesce(max(reason), '') AS disabled_reason
    FROM counted c LEFT JOIN blocked b ON c.api_key = b.api_key AND c.month = b.month GROUP BY c.api_key, c.month""", **BLOCKS))
def quota_counters(spark, sf_dir):
    return usage.quota_counters(shifted(spark, sf_dir), REQUEST_CAP, LLM_CAP)


@query("alert_daily_spike", usql("SELECT * FROM spikes"))
def alert_daily_spike(spark, sf_dir):
    return usage.alert_daily_spike(usage.daily_usage(shifted(spark, sf_dir)), ratio=SPIKE)


@query("alert_sustained_growth", usql("SELECT * FROM growth"))
def alert_sustained_growth(spark, sf_dir):
    return usage.alert_sustained_growth(usage.daily_usage(shifted(spark, sf_dir)), ratio=GROWTH)


def now():
    return F.lit(NOW).cast("timestamp")


@query("alert_fast_burn", usql("SELECT * FROM burns"))
def alert_fast_burn(spark, sf_dir):
    return usage.alert_fast_burn(shifted(spark, sf_dir), now(), expected_calls=EXPECTED)


@query("alert_cap_proximity", usql("SELECT * FROM near_cap"))
def alert_cap_proximity(spark, sf_dir):
    return usage.alert_cap_proximity(usage.monthly_usage(shifted(spark, sf_dir)), llm_cap=PROXIMITY_CAP)


def report(log):
    return usage.monitoring_report(log, now(), spike=SPIKE, growth=GROWTH, expected_calls=EXPECTED, llm_cap=PROXIMITY_CAP)


@query("monitoring_report", usql("SELECT tenant_id, month, message, rule FROM report"))
def monitoring_report(spark, sf_dir):
    return report(shifted(spark, sf_dir))


@query("usage_and_alerts", usql("""SELECT m.tenant_id, m.month, total_requests, llm_calls, estimated_ai_cost, peak_day,
    coalesce(alerts, '') AS alerts FROM monthly m LEFT JOIN peaks p ON m.tenant_id = p.tenant_id AND m.month = p.month LEFT JOIN
    (SELECT tenant_id, month, string_agg(message, '; ' ORDER BY rule) AS alerts FROM report GROUP BY ALL) a
    ON m.tenant_id = a.tenant_id AND m.month = a.month"""))
def usage_and_alerts(spark, sf_dir):
    out = usage.usage_and_alerts(shifted(spark, sf_dir), now(), spike=SPIKE, growth=GROWTH, expected_calls=EXPECTED, llm_cap=PROXIMITY_CAP)
    return day_text(out, "peak_day")


# -- limits ---------------------------------------------------------------

def log_replay(name: str, source: str, key: str, limit: str, window_us: int) -> dict[str, str]:
    """CTEs that replay a sliding log row by row, all keys side by side."""
    return {
        f"{name}_in": f"SELECT event_id, us, {key} AS k, {limit} AS lim, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM {source}",
        name: f"""SELECT k, 0::BIGINT AS rn, 0::BIGINT AS event_id, false AS accepted, CAST([] AS BIGINT[]) AS q FROM (SELECT DISTINCT k FROM {name}_in)
            UNION ALL SELECT k, rn, event_id, ok, CASE WHEN ok AND lim IS NOT NULL THEN list_append(q2, us) ELSE q2 END FROM
            (SELECT *, coalesce(len(q2) < lim, true) AS ok FROM
                (SELECT i.k, i.rn, i.event_id, i.us, i.lim, list_filter(r.q, lambda x: x > i.us - {window_us}) AS q2
                 FROM {name} r JOIN {name}_in i ON i.k = r.k AND i.rn = r.rn + 1))""",
    }


RATE = {"api_retrieve": 2, "api_predict": 2, "api_ingest_kb": 1, "api_feedback": 3}
ABUSE = {"api_retrieve": 2, "api_predict": 1, "api_ingest_kb": 1, "api_feedback": 1}
RATE_SECONDS, ABUSE_SECONDS = 3600, 86_400
KEY_RATE_SECONDS = 21_600  # one key asks for one endpoint a few times a day


def limit_sql(table: dict) -> str:
    return "CASE endpoint " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


@query("rate_limit_sliding_log", sql("SELECT event_id, accepted FROM steps WHERE rn > 0", recursive=True,
       **log_replay("steps", "request_log", "api_key || endpoint", limit_sql(RATE), KEY_RATE_SECONDS * 1_000_000)))
def rate_limit_sliding_log(spark, sf_dir):
    return limits.rate_limit(X.request_log(spark, sf_dir), RATE, KEY_RATE_SECONDS).select("event_id", "accepted")


@query("ip_abuse_sliding_log", sql("SELECT event_id, accepted FROM steps WHERE rn > 0", recursive=True,
       **log_replay("steps", "request_log", "ip || endpoint", limit_sql(ABUSE), ABUSE_SECONDS * 1_000_000)))
def ip_abuse_sliding_log(spark, sf_dir):
    return limits.abuse_limit(X.request_log(spark, sf_dir), ABUSE, ABUSE_SECONDS).select("event_id", "accepted")


@query("raw_trailing_rate", sql("""SELECT event_id, count(*) OVER (PARTITION BY endpoint ORDER BY us
    RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS raw FROM request_log"""))
def raw_trailing_rate(spark, sf_dir):
    log = X.request_log(spark, sf_dir).select("event_id", "us", "endpoint")
    return limits.trailing_counts(log, ["endpoint"], 3_600_000_000).select("event_id", "raw")


# -- access ---------------------------------------------------------------

SCOPE = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ENDPOINT_SCOPES.items()) + " END"
ENTITLED = f"""SELECT l.*, CASE WHEN scopes IS NULL THEN 401 WHEN NOT list_contains(scopes, {SCOPE}) THEN 403 ELSE 200 END AS scope_code,
    CASE WHEN status IN ('active', 'revoked') THEN 200 ELSE 403 END AS status_code, coalesce(status, '') AS key_status
    FROM request_log l LEFT JOIN api_keys a ON l.api_key = a.api_key"""


@query("entitlement_check", sql("SELECT event_id, scope_code, status_code, key_status FROM entitled", entitled=ENTITLED))
def entitlement_check(spark, sf_dir):
    out = access.entitlement(X.request_log(spark, sf_dir), X.api_keys(spark, sf_dir))
    return out.select("event_id", "scope_code", "status_code", F.coalesce("key_status", F.lit("")).alias("key_status"))


LOOKED = """SELECT k.lookup_id, k.interaction_id, k.tenant_id, s.purpose, s.key_points, CASE WHEN s.interaction_id IS NULL THEN 'unknown'
    WHEN k.requested_at < s.created_at THEN 'unknown' WHEN s.expires_at < k.requested_at THEN 'expired' ELSE 'valid' END AS state_status FROM lookups k LEFT JOIN states s
    ON s.interaction_id = k.interaction_id AND s.tenant_id = k.tenant_id"""


def looked_up(spark, sf_dir):
    log = X.request_log(spark, sf_dir)
    return access.lookup(X.interaction_lookups(log), X.interaction_states(log))


@query("interaction_lookup", sql("SELECT lookup_id, interaction_id, state_status FROM looked", looked=LOOKED))
def interaction_lookup(spark, sf_dir):
    return looked_up(spark, sf_dir).select("lookup_id", "interaction_id", "state_status")


@query("interaction_audit", sql(f"""SELECT lookup_id, interaction_id, tenant_id, {Q.mask('purpose', 'strict')} AS purpose,
    {Q.mask('key_points', 'strict')} AS key_points, 'allowed' AS decision_outcome FROM looked WHERE state_status = 'valid'""", looked=LOOKED))
def interaction_audit(spark, sf_dir):
    return access.audit_rows(looked_up(spark, sf_dir)).select(
        "lookup_id", "interaction_id", "tenant_id", "purpose", "key_points", "decision_outcome")


@query("interaction_log", sql(f"""SELECT k.interaction_id, k.tenant_id, CAST(NULL AS VARCHAR) AS session_id, workflow_type, {Q.mask('purpose', 'strict')} AS purpose,
    {Q.mask('key_points', 'strict')} AS key_points, {Q.mask('ops_query', 'strict')} AS ops_query, intent, intent_model_used, intent_confidence,
    retrieval_confidence, 'allowed' AS decision_outcome, generated_response FROM lookups k JOIN states s ON s.interaction_id = k.interaction_id
    AND s.tenant_id = k.tenant_id WHERE k.requested_at BETWEEN s.created_at AND s.expires_at"""))
def interaction_log(spark, sf_dir):
    path = work_dir(spark, "interaction-log")
    looked_up_rows = looked_up(spark, sf_dir)
    odd = F.col("lookup_id") % 2
    for batch, part in ((0, odd == 0), (1, odd == 1), (1, odd == 1)):   # the second batch arrives twice
        sinks.write_audit(access.audit_log(looked_up_rows.filter(part)), path, batch)
    return sinks.read_audit(spark, path, access.AUDIT_SCHEMA)


def log_rows(spark, sf_dir) -> dict:
    """Rows of each kind of log, from requests, states and lookups."""
    log = X.request_log(spark, sf_dir).withColumns({
        "request_id": F.col("event_id").cast("string"), "created_at": F.col("ts"), "timestamp": F.col("ts"),
        "interaction_id": F.col("event_id").cast("string"), "ip_hash": F.sha2("ip", 256)})
    valid = access.audit_log(looked_up(spark, sf_dir)).withColumn("request_id", F.concat(F.lit("r"), "interaction_id"))
    hit = F.struct(F.lit(1).alias("rank"), F.col("retrieval_confidence").alias("score"), F.lit("KB").alias("source"),
                   F.col("key_points").alias("chunk_preview"))
    summary = F.struct(F.col("ops_query").alias("summary"), F.array("purpose", "key_points").alias("key_details"))
    return {
        "api_requests": log.withColumns({"status": F.lit("success"), "latency_ms": F.col("event_id") % 900, "user_agent": F.lit('a "b"\\c')}),
        "escalation": log.filter("event_id % 5 = 0").withColumn("escalation_reason", F.lit("low confidence\nof the answer")),
        "kb_ingestion_status": log.filter("endpoint = 'api_ingest_kb'").withColumns({
            "status": F.when(F.col("event_id") % 2 == 0, "success").otherwise("failure"), "filename": F.concat("request_id", F.lit(".txt")),
            "error": F.when(F.col("event_id") % 2 == 1, "too_many_vectors")}),
        "intent_model_status": valid.withColumn("intent_status", F.when(F.col("intent_model_used"), "ok").otherwise("unused")),
        "api_retrieval_results": valid.withColumn("retrieval_results", F.array(hit)),
        "api_predict_results": valid.withColumns({"customer_context_summary": summary, "generated_reply": F.col("generated_response")}),
        "feedback": log.filter("endpoint = 'api_feedback'").withColumns({
            "feedback_type": F.when(F.col("rating") > 3, "positive").otherwise("other"), "comment": F.trim("purpose")}),
    }


LOG_TEXTS = {   # what is compared of each kind; a missing field is empty
    "api_requests": ("request_id", "endpoint", "status", "latency_ms", "user_agent", "ip_hash"),
    "escalation": ("request_id", "tenant_id", "escalation_reason", "ip_hash"),
    "kb_ingestion_status": ("request_id", "status", "filename", "error"),
    "intent_model_status": ("interaction_id", "intent", "intent_model_used", "intent_status"),
    "api_retrieval_results": ("interaction_id", "retrieval_results[0].rank", "retrieval_results[0].chunk_preview"),
    "api_predict_results": ("request_id", "purpose", "ops_query", "customer_context_summary.key_details[1]", "generated_reply"),
    "feedback": ("interaction_id", "rating", "feedback_type", "comment"),
}
VALID_LOG = f"""SELECT k.interaction_id, {Q.mask('purpose', 'strict')} AS purpose, {Q.mask('key_points', 'strict')} AS key_points, intent, intent_model_used,
    {Q.mask('ops_query', 'strict')} AS ops_query, generated_response FROM lookups k JOIN states s ON s.interaction_id = k.interaction_id
    AND s.tenant_id = k.tenant_id WHERE k.requested_at BETWEEN s.created_at AND s.expires_at"""


@query("log_round_trip", sql("""SELECT 'api_requests' AS kind, concat(event_id, '|', endpoint, '|success|', event_id % 900, '|a "b"\\c|', sha256(ip)) AS record FROM request_log
    UNION ALL SELECT 'escalation', concat(event_id, '|', tenant_id, '|low confidence', chr(10), 'of the answer|', sha256(ip)) FROM request_log WHERE event_id % 5 = 0
    UNION ALL SELECT 'kb_ingestion_status', concat(event_id, CASE WHEN event_id % 2 = 0 THEN '|success|' ELSE '|failure|' END, event_id, '.txt|',
        CASE WHEN event_id % 2 = 1 THEN 'too_many_vectors' END) FROM request_log WHERE endpoint = 'api_ingest_kb'
    UNION ALL SELECT 'intent_model_status', concat(interaction_id, '|', intent, '|', intent_model_used, CASE WHEN intent_model_used THEN '|ok' ELSE '|unused' END) FROM valid_log
    UNION ALL SELECT 'api_retrieval_results', concat(interaction_id, '|1|', key_points) FROM valid_log
    UNION ALL SELECT 'api_predict_results', concat('r', interaction_id, '|', purpose, '|', ops_query, '|', key_points, '|', generated_response) FROM valid_log
    UNION ALL SELECT 'feedback', concat(event_id, '|', rating, CASE WHEN rating > 3 THEN '|positive|' ELSE '|other|' END, trim(purpose))
        FROM request_log WHERE endpoint = 'api_feedback'""", valid_log=VALID_LOG))
def log_round_trip(spark, sf_dir):
    path = work_dir(spark, "all-logs")
    parts = []
    for kind, rows in log_rows(spark, sf_dir).items():
        sinks.write_log(rows, path, kind)
        texts = [F.coalesce(F.expr(c).cast("string"), F.lit("")) for c in LOG_TEXTS[kind]]
        parts.append(readers.scan_logs(spark, f"{path}/{kind}", kind).select(F.lit(kind).alias("kind"), F.concat_ws("|", *texts).alias("record")))
    return reduce(DataFrame.unionByName, parts)


ADMIT_RATE = {"api_retrieve": 3, "api_predict": 3, "api_ingest_kb": 2, "api_feedback": 3}
ADMIT_ABUSE = {"api_retrieve": 4, "api_predict": 3, "api_ingest_kb": 3}
ADMIT_CAPS = (110, 22)
ADMIT_SECONDS = 86_400
ADMISSION = {
    "entitled": ENTITLED,
    "entered": "SELECT * FROM entitled WHERE scope_code = 200",
    **log_replay("rate_steps", "entered", "api_key || endpoint", limit_sql(ADMIT_RATE), ADMIT_SECONDS * 1_000_000),
    "second": """SELECT e.*, CASE WHEN NOT r.accepted THEN 'rate_limited'
        WHEN abs((epoch_us(seen_ts) // 1000000) - (us // 1000000)) > 600 THEN 'stale' WHEN status_code <> 200 THEN 'disabled_key'
        WHEN endpoint = 'api_retrieve' AND length(trim(purpose)) < 5 THEN 'bad_input' END AS outcome
        FROM entered e JOIN rate_steps r ON r.event_id = e.event_id AND r.rn > 0""",
    "clean": "SELECT * FROM second WHERE outcome IS NULL",
    **log_replay("abuse_steps", "clean", "ip || endpoint", limit_sql(ADMIT_ABUSE), ADMIT_SECONDS * 1_000_000),
    "third": "SELECT c.* EXCLUDE (outcome), CASE WHEN NOT r.accepted THEN 'abuse_detected' END AS outcome FROM clean c JOIN abuse_steps r ON r.event_id = c.event_id AND r.rn > 0",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY api_key, strftime(ts, '%Y-%m') ORDER BY us, event_id) AS rn,
        CASE WHEN is_capped THEN row_number() OVER (PARTITION BY api_key, strftime(ts, '%Y-%m'), is_capped ORDER BY us, event_id) END AS ln, strftime(ts, '%Y-%m') AS month
        FROM third WHERE outcome IS NULL""",
    "stops": f"""SELECT api_key, month, min(rn) AS stop_rn, arg_min(reason, rn * 2 + late) AS reason FROM
        (SELECT api_key, month, rn, 0 AS late, '{K.REQUEST_CAP_REASON}' AS reason FROM numbered WHERE rn = {ADMIT_CAPS[0] + 1}
         UNION ALL SELECT api_key, month, rn, 1, '{K.LLM_CAP_REASON}' FROM numbered WHERE ln = {ADMIT_CAPS[1] + 1}) GROUP BY ALL""",
}


ADMISSION["capped"] = f"""SELECT n.*, CASE WHEN rn >= stop_rn THEN s.reason ELSE 'admitted' END AS outcome,
    coalesce(rn < stop_rn OR (rn = stop_rn AND s.reason = '{K.LLM_CAP_REASON}'), true) AS counted
    FROM (SELECT * EXCLUDE (outcome) FROM numbered) n LEFT JOIN stops s ON n.api_key = s.api_key AND n.month = s.month"""


@query("request_admission_replay", sql("""SELECT event_id, CASE scope_code WHEN 401 THEN 'unknown_key' ELSE 'missing_scope' END AS outcome, false AS counted
    FROM entitled WHERE scope_code <> 200 UNION ALL SELECT event_id, outcome, false FROM second WHERE outcome IS NOT NULL
    UNION ALL SELECT event_id, outcome, false FROM third WHERE outcome IS NOT NULL
    UNION ALL SELECT event_id, outcome, counted FROM capped""", recursive=True, **ADMISSION))
def request_admission_replay(spark, sf_dir):
    return replayed(spark, sf_dir).select("event_id", "outcome", "counted")


@query("admission_usage", sql("""SELECT tenant_id, month, count(*) AS total_requests, count(*) FILTER (WHERE is_llm AND outcome = 'admitted') AS llm_calls,
    count(*) FILTER (WHERE is_llm AND outcome = 'admitted') * 5 AS estimated_ai_cost FROM capped WHERE counted GROUP BY ALL""", recursive=True, **ADMISSION))
def admission_usage(spark, sf_dir):
    return access.counted_usage(replayed(spark, sf_dir))


def replayed(spark, sf_dir):
    given = rules.ticket_gate(F.col("purpose"), F.lit("internal_ops"), F.lit(""), F.lit(""), F.lit("refund window"))
    return access.admission_replay(
        X.request_log(spark, sf_dir), X.api_keys(spark, sf_dir), ADMIT_RATE, ADMIT_ABUSE, *ADMIT_CAPS,
        rate_seconds=ADMIT_SECONDS, abuse_seconds=ADMIT_SECONDS, skew_seconds=600,
        input_ok=(F.col("endpoint") != "api_retrieve") | (given["gate_status"] == "PASS"))
