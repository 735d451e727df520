"""Predicates and rule-based classification as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from kbspark import constants as K
from kbspark.functions import text as X


def meaningful_text(c: Column) -> Column:
    def test(squeezed):
        rest = squeezed
        for _ in range(3):  # what is left once three different characters are taken out
            rest = F.replace(rest, F.substring(rest, 1, 1), F.lit(""))
        return (F.length(squeezed) >= 6) & squeezed.rlike("[a-zA-Z0-9]{3,}") & (F.length(rest) > 0)

    return X.bind(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""), test)


def file_rejection(
    name: Column, size_bytes: Column, extensions=K.KB_EXTENSIONS, max_bytes: int = K.KB_MAX_BYTES
) -> Column:
    """Code of the first admission rule a file breaks; null when admitted."""
    return (
        F.when(name.isNull() | (name == ""), "MISSING_FILE_NAME")
        .when(~X.file_extension(name).isin(*extensions), "UNSUPPORTED_FILE_TYPE")
        .when(size_bytes > max_bytes, "FILE_TOO_LARGE")
    )


def attachment_rejection(
    name: Column, size_bytes: Column, extensions=K.ATTACHMENT_EXTENSIONS,
    max_bytes: int = K.ATTACHMENT_MAX_BYTES,
) -> Column:
    return F.when(~X.file_extension(name).isin(*extensions), "unsupported_file_type").when(
        size_bytes > max_bytes, "file_too_large"
    )


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def workflow(flags: dict[str, Column]) -> Column:
    """Name of the first workflow whose flag is set; null when none is."""
    return F.coalesce(*[F.when(truthy(flags[key]), name) for key, name in K.WORKFLOWS if key in flags])


def keyword_hit(c: Column, keywords=K.HARD_KEYWORDS, whole_words: bool = False) -> Column:
    """First keyword, in list order, that occurs in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    test = (lambda k: low.rlike(r"(?U)\b" + k + r"\b")) if whole_words else low.contains
    return F.coalesce(*[F.when(test(k), k) for k in keywords])


def feedback_bucket(rating: Column) -> Column:
    return F.when(rating >= 4, "positive").when(rating == 3, "neutral").otherwise("needs_review")


def feedback_comment(comment: Column) -> Column:
    """The comment without white space around it; nothing left is no comment."""
    return F.nullif(X.strip(comment), F.lit(""))


def tone(original: Column, sentiment: Column, intent: Column) -> Column:
    negative = F.upper(F.coalesce(sentiment, F.lit(""))) == "NEGATIVE"
    return F.when(negative & intent.isin(*K.EMPATHY_INTENTS), "empathetic").when(
        negative, "professional"
    ).otherwise(original)


def within_skew(event_time: Column, seen_time: Column, seconds: int = K.MAX_SKEW_SECONDS) -> Column:
    """True when both times are known and at most ``seconds`` (whole) apart."""
    gap = F.unix_seconds(seen_time.cast("timestamp")) - F.unix_seconds(event_time.cast("timestamp"))
    return F.coalesce(F.abs(gap) <= seconds, F.lit(False))


def ticket_gate(
    purpose: Column, workflow_type: Column, email: Column, cleaned_email: Column, query: Column,
    min_purpose: int = K.MIN_PURPOSE, min_query: int = K.MIN_QUERY, max_query: int = K.MAX_QUERY,
) -> Column:
    """Struct ``gate_status, gate_reason`` of the input checks, first hit wins."""
    support = workflow_type == "support_agent_assistance"
    blank = F.lit("")
    email_len = F.length(X.strip(F.coalesce(email, blank)))
    query_len = F.length(X.strip(F.coalesce(query, blank)))
    rules = [
        (F.length(X.strip(F.coalesce(purpose, blank))) < min_purpose, "REJECT", "purpose_required"),
        (workflow_type.isNull(), "REJECT", "no_workflow"),
        (support & (email_len == 0), "REJECT", "past_email_required"),
        (support & (email_len > 5) & ~meaningful_text(cleaned_email), "REJECT", "insufficient_information"),
        (~support & (query_len < min_query), "REJECT", "query_required"),
        (~support & (F.length(query) > max_query), "ESCALATE", "ops_query_too_long"),
    ]
    return first_rule(rules, ("PASS", ""), ("gate_status", "gate_reason"))


def first_rule(rules, default, names) -> Column:
    """Struct of the outcome of the first rule that holds."""
    def pick(pos):
        chain = reduce(
            lambda acc, r: acc.when(r[0], F.lit(r[pos + 1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][pos + 1]))
        )
        return chain.otherwise(F.lit(default[pos]))

    return F.struct(*[pick(i).alias(n) for i, n in enumerate(names)])


def escalation_reason(
    allow_hard: Column, intent: Column, confidence: Column, best_distance: Column, text: Column,
    min_confidence: float = K.MIN_CONFIDENCE, max_distance: float = K.MAX_BEST_DISTANCE,
) -> Column:
    """Why a ticket goes to a person; null when it is allowed.

    Distances and confidences are rounded in the message only."""
    hard = F.coalesce(allow_hard, F.lit(False))
    keyword = keyword_hit(text)
    return (
        F.when(hard & intent.isin(*K.HARD_INTENTS), F.concat(F.lit("hard_intent: "), intent))
        .when(
            confidence < min_confidence,
            F.format_string("retrieval_confidence %.6f below threshold", confidence),
        )
        .when(
            best_distance.isNull() | (best_distance > max_distance),
            F.concat(
                F.lit("best_distance "),
                F.coalesce(F.format_string("%.6f", best_distance), F.lit("None")),
                F.lit(" exceeds threshold"),
            ),
        )
        .when(hard & keyword.isNotNull(), F.concat(F.lit("keyword: "), keyword))
    )


def display_reason(reason: Column) -> Column:
    return F.coalesce(
        *[F.when(reason.contains(key), shown) for key, shown in K.DISPLAY_REASONS], F.lit("low_confidence")
    )
