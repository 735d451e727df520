"""Ticket queries: attachments, assembled text, escalation, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import fixtures as X
from kbspark.catalog import sqlkit as Q
from kbspark.catalog.fixtures import sql
from kbspark.catalog.retrieval_queries import RETRIEVAL, six
from kbspark.catalog.text_queries import WORKFLOW, gate_sql
from kbspark.functions import rules
from kbspark.operators import retrieval, tickets

QUERIES: dict = {}
ORACLES: dict = {}
MAX_FILES = 4      # scaled down so that both outcomes occur in the given tables


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def attachments(spark, sf_dir):
    """All turns of other roles."""
    return X.messages(spark, sf_dir).filter("role <> 'user'").select(
        F.col("conv_id").alias("ticket_id"), F.col("turn").alias("pos"), "body", "file_name", "size_bytes")


TICKET_CTES = {
    "files": f"""SELECT conv_id AS ticket_id, turn AS pos, body, size_bytes,
        CASE WHEN regexp_extract({Q.safe_file_name('file_name')}, '[.][^.]*$') NOT IN ('.pdf', '.txt') THEN 'unsupported_file_type'
             WHEN size_bytes > 5242880 THEN 'file_too_large' END AS bad FROM messages WHERE role <> 'user'""",
    "verdicts": f"""SELECT ticket_id, count(*) AS n_files, CASE WHEN count(*) > {MAX_FILES} THEN 'too_many_attachments'
        ELSE arg_min(bad, pos) FILTER (WHERE bad IS NOT NULL) END AS reason FROM files GROUP BY ticket_id""",
    "parts": f"""SELECT ticket_id, string_agg(part || '\n\n', '' ORDER BY pos) AS listed FROM
        (SELECT ticket_id, pos, substring({Q.email_clean('body')}, 1, 4000) AS part FROM files
         WHERE ticket_id IN (SELECT ticket_id FROM verdicts WHERE reason IS NULL)) WHERE length(part) > 0 GROUP BY ticket_id""",
}


@query("attachment_admission", sql("SELECT ticket_id, n_files, coalesce(reason, '') AS reason FROM verdicts", **TICKET_CTES))
def attachment_admission(spark, sf_dir):
    v = tickets.attachment_verdicts(attachments(spark, sf_dir), MAX_FILES)
    return v.select("ticket_id", "n_files", F.coalesce("reason", F.lit("")).alias("reason"))


@query("ticket_text_assemble", sql(f"""SELECT ticket_id, CAST(length(email) AS INTEGER) AS email_len,
    CASE WHEN email = '' THEN '' ELSE 'CUSTOMER MESSAGE:\n' || email END ||
    CASE WHEN listed IS NULL THEN '' ELSE '\n\nATTACHMENTS:\n' || listed END AS text
    FROM (SELECT ticket_id, substring({Q.email_clean('body')}, 1, 5000) AS email FROM emails) LEFT JOIN parts USING (ticket_id)""",
                                   **TICKET_CTES))
def ticket_text_assemble(spark, sf_dir):
    files = attachments(spark, sf_dir)
    return tickets.assemble(X.emails(spark, sf_dir), files, tickets.attachment_verdicts(files, MAX_FILES))


def reason_sql(text: str) -> str:
    kw = Q.keyword_hit(text)
    return f"""CASE WHEN allow_hard_escalate AND intent IN ('refund_request', 'complaint') THEN 'hard_intent: ' || intent
    WHEN confidence < 0.35 THEN 'retrieval_confidence ' || printf('%.6f', confidence) || ' below threshold'
    WHEN best_distance IS NULL OR best_distance > 0.55 THEN 'best_distance ' || coalesce(printf('%.6f', best_distance), 'None') || ' exceeds threshold'
    WHEN allow_hard_escalate AND {kw} IS NOT NULL THEN 'keyword: ' || {kw} END"""


SHOWN = """CASE WHEN contains(why, 'retrieval_confidence') OR contains(why, 'best_distance') THEN 'low_confidence'
    WHEN contains(why, 'keyword') OR contains(why, 'hard_intent') THEN 'high_risk_operation' ELSE 'low_confidence' END"""
ESCALATION = {
    **RETRIEVAL,
    "judged": f"""SELECT ticket_id, {reason_sql("coalesce(past_email, query)")} AS why FROM tickets JOIN bundles ON query_id = ticket_id""",
}


def judged(spark, sf_dir):
    found = retrieval.bundle(retrieval.retrieve(X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir)))
    t = X.tickets(spark, sf_dir).join(found.withColumnRenamed("query_id", "ticket_id"), "ticket_id")
    why = rules.escalation_reason(
        F.col("allow_hard_escalate"), F.col("intent"), F.col("confidence"), F.col("best_distance"),
        F.coalesce("past_email", "query"))
    return t.select("ticket_id", why.alias("why"))


@query("escalation_decision", sql("""SELECT ticket_id, CASE WHEN why IS NULL THEN 'ALLOW' ELSE 'ESCALATE' END AS decision,
    coalesce(why, '') AS reason FROM judged""", **ESCALATION))
def escalation_decision(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "ticket_id", F.when(F.col("why").isNull(), "ALLOW").otherwise("ESCALATE").alias("decision"),
        F.coalesce("why", F.lit("")).alias("reason"))


@query("display_reason", sql(f"SELECT ticket_id, {SHOWN} AS reason FROM judged WHERE why IS NOT NULL", **ESCALATION))
def display_reason(spark, sf_dir):
    kept = judged(spark, sf_dir).filter("why is not null")
    return kept.select("ticket_id", rules.display_reason(F.col("why")).alias("reason"))


TRIAGE = {
    **RETRIEVAL,
    "gated": f"""SELECT *, {gate_sql('email')} FROM (SELECT *, {WORKFLOW} AS wf, past_email AS raw_email,
        substring({Q.email_clean("coalesce(past_email, '')")}, 1, 5000) AS email FROM tickets)""",
    "stated": f"""SELECT *, CASE WHEN gate_status <> 'PASS' THEN gate_status
        WHEN wf = 'support_agent_assistance' AND NOT {Q.meaningful('email')} THEN 'ESCALATE' ELSE 'PASS' END AS status,
        CASE WHEN gate_status <> 'PASS' THEN gate_reason
        WHEN wf = 'support_agent_assistance' AND NOT {Q.meaningful('email')} THEN 'insufficient_information' ELSE '' END AS state_reason,
        CASE WHEN wf = 'support_agent_assistance' THEN email ELSE query END AS risk_text FROM gated""",
    "judged_all": f"""SELECT ticket_id, wf, status, state_reason, CASE WHEN status = 'PASS' THEN coalesce(confidence, 0) ELSE 0 END AS confidence,
        CASE WHEN status = 'PASS' THEN top_source END AS top_source,
        CASE WHEN status = 'PASS' THEN {reason_sql('risk_text')} END AS why FROM stated LEFT JOIN bundles ON query_id = ticket_id""",
}


@query("ticket_triage", sql(f"""SELECT ticket_id, coalesce(wf, 'none') AS workflow_type,
    CASE WHEN status <> 'PASS' THEN status WHEN why IS NOT NULL THEN 'ESCALATE' ELSE 'ALLOW' END AS decision,
    CASE WHEN status <> 'PASS' THEN state_reason WHEN why IS NOT NULL THEN {SHOWN} ELSE '' END AS reason,
    coalesce(why, '') AS detail, round(confidence, 6) AS confidence, coalesce(top_source, '') AS top_source FROM judged_all""", **TRIAGE))
def ticket_triage(spark, sf_dir):
    out = tickets.triage(X.tickets(spark, sf_dir), X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir))
    return out.withColumn("confidence", six("confidence"))
