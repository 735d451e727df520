"""Tickets: attachments, assembled text, gates and the final decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kbspark import constants as K
from kbspark.functions import rules as R
from kbspark.functions import text as X
from kbspark.operators import retrieval
from kbspark.session import cut_lineage


def attachment_verdicts(attachments: DataFrame, max_files: int = K.MAX_ATTACHMENTS) -> DataFrame:
    """ticket_id, n_files, reason of tickets with attachments: too many files,
    or the first file (by ``pos``) that is refused; null when all pass.
    Counts and minima combine before the shuffle: no ticket is collected."""
    name = X.safe_file_name(F.col("file_name"))
    reason = R.attachment_rejection(name, F.col("size_bytes"))
    first_bad = F.min(F.when(reason.isNotNull(), F.struct("pos", reason.alias("reason"))))
    per_ticket = attachments.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n_files"), first_bad.alias("bad"))
    return per_ticket.select(
        "ticket_id", "n_files",
        F.when(F.col("n_files") > max_files, "too_many_attachments").otherwise(F.col("bad.reason")).alias("reason"),
    )


def assemble(
    emails: DataFrame, attachments: DataFrame, verdicts: DataFrame,
    email_chars: int = K.EMAIL_CHARS, attachment_chars: int = K.ATTACHMENT_CHARS,
) -> DataFrame:
    """ticket_id, email_len, text: the cleaned message, then its attachments.

    Only attachments of tickets that passed the file rules are gathered, so a
    ticket brings no more than the permitted number of bounded texts."""
    passed = verdicts.filter(F.col("reason").isNull()).select("ticket_id")
    cleaned = attachments.select(
        "ticket_id", "pos", X.truncate(X.email_clean(X.strip(F.col("body"))), attachment_chars).alias("part")
    ).filter(F.length("part") > 0)
    parts = cleaned.join(passed, "ticket_id", "left_semi").groupBy("ticket_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    email = X.truncate(X.email_clean(F.col("body")), email_chars)
    message = F.when(F.length("email") > 0, F.concat(F.lit("CUSTOMER MESSAGE:\n"), F.col("email"))).otherwise("")
    listed = F.array_join(F.transform("parts", lambda p: F.concat(p["part"], F.lit("\n\n"))), "")
    return emails.select("ticket_id", email.alias("email")).join(parts, "ticket_id", "left").select(
        "ticket_id",
        F.length(X.strip(F.col("email"))).alias("email_len"),
        F.concat(
            message,
            F.when(F.col("parts").isNotNull(), F.concat(F.lit("\n\nATTACHMENTS:\n"), listed)).otherwise(""),
        ).alias("text"),
    )


def gate(tickets: DataFrame) -> DataFrame:
    """Tickets with workflow, cleaned text and the outcome of the input checks.

    Optional columns: ``attachments_text`` (as assembled) and ``summary`` with
    ``key_details`` (a model's); without a summary the assembled text serves."""
    has = set(tickets.columns)
    flags = {key: F.col(key) for key, _ in K.WORKFLOWS if key in has}
    email = X.truncate(X.email_clean(X.strip(F.col("past_email"))), K.EMAIL_CHARS)
    base = tickets.withColumn("workflow_type", R.workflow(flags)).withColumn("email", email)
    support = F.col("workflow_type") == "support_agent_assistance"
    message = F.concat(
        F.when(F.length("email") > 0, F.concat(F.lit("CUSTOMER MESSAGE:\n"), F.col("email"))).otherwise(""),
        F.coalesce(F.col("attachments_text"), F.lit("")) if "attachments_text" in has else F.lit(""),
    )
    base = base.withColumn("bounded", X.length_gate(message, F.length("email"))).withColumn(
        "g", R.ticket_gate(F.col("purpose"), F.col("workflow_type"), F.col("past_email"), F.col("email"), F.col("query"))
    )
    summary = F.when(support, F.col("summary") if "summary" in has else F.col("email"))
    base = base.withColumn("summary", summary)
    passed = F.col("g.gate_status") == "PASS"
    outcome = R.first_rule(
        [
            (~passed, None, None),
            (support & F.col("bounded.too_long"), "ESCALATE", "input_too_long"),
            (support & ~R.meaningful_text(F.col("summary")), "ESCALATE", "insufficient_information"),
        ],
        ("PASS", ""), ("status", "reason"),
    )
    details = F.col("key_details") if "key_details" in has else F.array().cast("array<string>")
    return base.withColumn("o", outcome).select(
        "ticket_id", "workflow_type", "intent", "allow_hard_escalate",
        F.coalesce("o.status", "g.gate_status").alias("gate_status"),
        F.coalesce("o.reason", "g.gate_reason").alias("gate_reason"),
        F.coalesce(F.col("summary"), F.col("query")).alias("risk_text"),
        X.query_text(
            F.col("summary"), details, F.col("query"), X.key_points_plain(F.col("key_points"))
        ).alias("query_text"),
    )


def decide(gated: DataFrame, bundles: DataFrame) -> DataFrame:
    """One decision per ticket: the gate's, or the escalation rules' over what
    was retrieved for the ticket (``bundles`` by query_id)."""
    found = bundles.select(F.col("query_id").alias("ticket_id"), "confidence", "best_distance", "sources")
    joined = gated.join(found, "ticket_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    passed = F.col("gate_status") == "PASS"
    reason = R.escalation_reason(
        F.col("allow_hard_escalate"), F.col("intent"), F.col("confidence"), F.col("best_distance"), F.col("risk_text")
    )
    joined = joined.withColumn("why", F.when(passed, reason))
    return joined.select(
        "ticket_id",
        F.coalesce("workflow_type", F.lit("none")).alias("workflow_type"),
        F.when(~passed, F.col("gate_status")).when(F.col("why").isNotNull(), "ESCALATE").otherwise("ALLOW").alias("decision"),
        F.when(~passed, F.col("gate_reason")).when(F.col("why").isNotNull(), R.display_reason(F.col("why")))
        .otherwise("").alias("reason"),
        F.coalesce("why", F.lit("")).alias("detail"),
        "confidence",
        F.coalesce(F.get("sources", F.lit(0)), F.lit("")).alias("top_source"),
    )


def triage(tickets: DataFrame, vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """Decision of every ticket. ``vectors`` (query_id, vector) holds the
    embedded query text per ticket; only tickets that pass the gates are
    searched for, and their gate columns are computed once."""
    gated = cut_lineage(gate(tickets), "gated")
    asked = gated.filter("gate_status = 'PASS'").select(F.col("ticket_id").alias("query_id"))
    hits = retrieval.retrieve(vectors.join(asked, "query_id", "left_semi"), corpus)
    return decide(gated, retrieval.bundle(hits))
