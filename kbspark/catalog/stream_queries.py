"""Streams run to completion over the given tables; each must give what its
batch twin gives, so the same SQL checks both."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import fixtures as X
from kbspark.catalog import kb_queries as KB
from kbspark.catalog import sqlkit as Q
from kbspark.catalog import usage_queries as U
from kbspark.catalog.fixtures import sql
from kbspark.operators import usage
from kbspark.session import ensure_utc, work_dir
from kbspark.sources import readers, sinks
from kbspark.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def log_stream(spark, sf_dir):
    return X.log_columns(jobs.table_stream(ensure_utc(spark), sf_dir, "events.parquet"))


def finished(spark, stream, name):
    path = work_dir(spark, name)
    jobs.run_available(stream, path, work_dir(spark, f"{name}-progress"))
    return spark.read.parquet(path)


@query("rate_limit_stream", U.ORACLES["rate_limit_sliding_log"])
def rate_limit_stream(spark, sf_dir):
    answers = jobs.limited(log_stream(spark, sf_dir), ("api_key", "endpoint"), U.RATE, U.KEY_RATE_SECONDS)
    return finished(spark, answers, "rate-limit")


@query("ip_abuse_stream", U.ORACLES["ip_abuse_sliding_log"])
def ip_abuse_stream(spark, sf_dir):
    answers = jobs.limited(log_stream(spark, sf_dir), ("ip", "endpoint"), U.ABUSE, U.ABUSE_SECONDS)
    return finished(spark, answers, "ip-abuse")


@query("quota_state_stream", U.ORACLES["cap_autoblock"])
def quota_state_stream(spark, sf_dir):
    log = X.shift_days(log_stream(spark, sf_dir), 15)
    return finished(spark, jobs.quota(log, U.REQUEST_CAP, U.LLM_CAP), "quota")


def streamed_usage(spark, sf_dir) -> str:
    path = work_dir(spark, "usage-stream")
    log = X.shift_days(log_stream(spark, sf_dir), 15)
    jobs.run_available(log, path, work_dir(spark, "usage-progress"), jobs.usage_sink(path))
    return path


@query("usage_counters_stream", U.ORACLES["usage_monthly"])
def usage_counters_stream(spark, sf_dir):
    return sinks.read_usage(spark, streamed_usage(spark, sf_dir))


@query("usage_daily_stream", U.ORACLES["usage_daily"])
def usage_daily_stream(spark, sf_dir):
    return U.day_text(sinks.read_daily_usage(spark, streamed_usage(spark, sf_dir)), "usage_date")


@query("usage_peak_day_stream", U.ORACLES["usage_peak_day"])
def usage_peak_day_stream(spark, sf_dir):
    return U.day_text(usage.peak_day(sinks.read_daily_usage(spark, streamed_usage(spark, sf_dir))), "peak_day")


def closing_event(events, folder: str) -> None:
    """A retrieval of a user that nobody is two days after the last event, as a heartbeat at the end of the log."""
    retrieval = next(kind for kind, endpoint in X.ENDPOINT_BY_EVENT if endpoint == "api_retrieve")
    given = {"event_id": F.lit(-1), "user_id": F.lit(-1), "event_type": F.lit(retrieval), "ts": F.col("last") + F.expr("INTERVAL 2 DAYS")}
    events.agg(F.max("ts").alias("last")).select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields
    ]).write.mode("append").parquet(folder)


@query("interaction_ttl_join", U.ORACLES["interaction_lookup"])
def interaction_ttl_join(spark, sf_dir):
    events = ensure_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    beats, path, progress = (work_dir(spark, f"interactions-{name}") for name in ("beats", "out", "progress"))
    events.limit(0).write.parquet(beats)   # the folder is there before its first heartbeat

    def log():
        stream = jobs.table_stream(spark, sf_dir, "events.parquet").unionByName(spark.readStream.schema(events.schema).parquet(beats))
        return X.log_columns(stream)

    for close in (False, True):
        if close:
            closing_event(events, beats)
        joined = jobs.interactions(X.interaction_states(log()), X.interaction_lookups(log()))
        jobs.run_available(joined.select("lookup_id", "interaction_id", "state_status"), path, progress)
    return spark.read.parquet(path).filter("lookup_id >= 0")


def index_ctes() -> dict[str, str]:
    """The batch build of every file on its own."""
    ctes = {**KB.INGEST, **KB.file_contest()}
    cleaned = f"SELECT doc_id, text, 'doc' || doc_id || '.txt' AS stored_name, {Q.kb_clean('text')} AS clean_text FROM documents"
    ctes["accepted"] = """SELECT doc_id, stored_name, clean_text
        FROM cleaned WHERE length(clean_text) >= 100 AND regexp_matches(clean_text, '[a-zA-Z0-9]{3,}')"""
    return {"cleaned": cleaned, **ctes}


@query("kb_incremental_index", sql("""SELECT stored_name AS file_name, CAST(chunk_index AS INTEGER) AS chunk_index, text, 64 AS dim, NULL AS reason
    FROM whole WHERE id NOT IN (SELECT id FROM losers) UNION ALL
    SELECT 'doc' || doc_id || '.txt', NULL, NULL, NULL, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(clean_text) < 100 THEN 'too_short' ELSE 'no_tokens' END
    FROM cleaned WHERE text IS NULL OR text = '' OR length(clean_text) < 100 OR NOT regexp_matches(clean_text, '[a-zA-Z0-9]{3,}')""", recursive=True, **index_ctes()))
def kb_incremental_index(spark, sf_dir):
    docs = jobs.table_stream(ensure_utc(spark), sf_dir, "documents.parquet")
    files = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("text").alias("content"))
    path = work_dir(spark, "index")
    jobs.run_available(files, path, work_dir(spark, "index-progress"), jobs.index_sink(path, dim=64, max_vectors=None))
    chunks = jobs.read_index(spark, path).select("file_name", "chunk_index", "text", F.size("embedding").alias("dim"))
    return chunks.unionByName(jobs.index_rejects(spark, path).select("file_name", "reason"), allowMissingColumns=True)


@query("log_append_stream", sql("SELECT tenant_id, CAST(event_id AS VARCHAR) AS request_id, endpoint, us, 'success' AS status FROM request_log"))
def log_append_stream(spark, sf_dir):
    path = work_dir(spark, "log-stream")
    rows = log_stream(spark, sf_dir).select(
        "tenant_id", F.col("event_id").cast("string").alias("request_id"), "endpoint", F.col("ts").alias("created_at"),
        F.lit("success").alias("status"))
    jobs.run_available(rows, path, work_dir(spark, "log-progress"), jobs.log_sink(path))
    return readers.scan_logs(spark, path, "api_requests").select(
        "tenant_id", "request_id", "endpoint", F.unix_micros("created_at").alias("us"), "status")
