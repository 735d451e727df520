"""Text preparation as column expressions: no Python worker is involved.

Patterns carry Java flags so that they read like Python's: ``(?d)`` makes ``.``
and ``$`` stop at a line feed only, ``(?U)`` makes ``\\s \\d \\b`` Unicode aware.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F

from kbspark import constants as K

# Boilerplate removed from knowledge-base text, in order.
KB_NOISE = (
    r"(?idU)this document.*confidential.*",
    r"(?idU)do not distribute.*",
    r"(?idU)all rights reserved.*",
    r"(?idU)terms and conditions.*",
    r"(?idU)privacy policy.*",
    r"(?idU)copyright.*",
    r"(?iU)page \d+ of \d+",
    r"[-_=]{5,}",
)

# Thread headers, signatures and disclaimers in e-mail, in order.
EMAIL_NOISE = (
    r"(?md)^>.*$",
    r"(?iudU)On .* wrote:",
    r"(?iudU)From:.*",
    r"(?iudU)Sent:.*",
    r"(?iudU)To:.*",
    r"(?iudU)Subject:.*",
    r"(?iudU)-----Original Message-----",
    r"(?iudU)----- Forwarded message -----",
    r"(?siudU)--\s*\n.*$",
    r"(?siudU)Thanks[,]?\n.*$",
    r"(?siudU)Best regards[,]?\n.*$",
    r"(?siudU)Regards[,]?\n.*$",
    r"(?siudU)Sincerely[,]?\n.*$",
    r"(?siudU)this email.*confidential.*",
    r"(?siudU)this message.*confidential.*",
    r"(?siudU)intended solely for.*",
)

# Personal data masks, in order.
PII_MASKS = (
    (r"(?U)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[EMAIL]"),
    (r"(?U)(?:\+?\d{1,3}[\s-]?)?\d{5}[\s-]?\d{5}", "[PHONE]"),
    (r"(?U)\b(?:\d[ -]*?){13,19}\b", "[CARD]"),
    (r"(?U)https?://\S+|www\.\S+", "[URL]"),
    (r"(?U)\b[A-Za-z0-9_\-]{20,}\b", "[TOKEN]"),
)
PII_STRICT = (
    (r"(?U)\b\d{6,}\b", "[ID]"),
    (r"(?U)\b[A-Z]{2,}[-_]\d{3,}\b", "[ID]"),
)
PII_RELAXED = ((r"(?U)\b\d{10,}\b", "[ID]"),)
STRICT_CHARS = 500


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character, not only spaces."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def replace_all(c: Column, patterns, value: str = "") -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, value)
    return c


def collapse_blank(c: Column) -> Column:
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


# -- chunks ---------------------------------------------------------------

def chunk_texts(text: Column, max_len: int = K.CHUNK_LEN, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Array of the overlapping, stripped, non-empty windows of ``text``.

    The text is cut once into strides (one linear pass); a window is its stride
    plus the head of the strides after it. The strides are the one element of an array, so that
    all windows read what was cut: named inside, the text would be cut again for every window."""
    stride = max_len - overlap
    strides = F.regexp_extract_all(strip(text), F.lit("(?s)(.{1,%d})" % stride), F.lit(1))
    spans = [min(stride, overlap - s) for s in range(0, overlap, stride)]

    def windows(strides):
        def window(s, i):
            tails = [
                F.coalesce(F.substring(F.get(strides, i + n), 1, span), F.lit(""))
                for n, span in enumerate(spans, start=1)
            ]
            return strip(F.concat(s, *tails))

        return F.filter(F.transform(strides, window), lambda c: F.length(c) > 0)

    return F.transform(F.array(strides), windows)[0]


def chunk_header(source: Column, file_name: Column, chunk_index: Column) -> Column:
    return F.format_string("[SOURCE:%s] [FILE:%s] [CHUNK:%d]", source, file_name, chunk_index)


def chunk_with_header(source: Column, file_name: Column, chunk_index: Column, text: Column) -> Column:
    return F.concat_ws("\n", chunk_header(source, file_name, chunk_index), text)


def parse_chunk(chunk: Column) -> Column:
    """Inverse of :func:`chunk_with_header`, as a struct."""
    head = F.substring_index(chunk, "\n", 1)
    pattern = r"^\[SOURCE:(.*?)\] \[FILE:(.*)\] \[CHUNK:(\d+)\]$"
    return F.struct(
        F.regexp_extract(head, pattern, 1).alias("source"),
        F.regexp_extract(head, pattern, 2).alias("file_name"),
        F.regexp_extract(head, pattern, 3).cast("int").alias("chunk_index"),
        F.substring(chunk, F.length(head) + 2, F.length(chunk)).alias("text"),
    )


def preview(text: Column, n: int = K.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, n)


def header_file(header: Column) -> Column:
    """Values of the ``[FILE:x]`` tokens of a chunk header, split on whitespace."""
    tokens = F.split(header, r"(?U)\s+")
    files = F.filter(tokens, lambda t: t.startswith("[FILE:"))
    return F.transform(files, lambda t: F.replace(F.replace(t, F.lit("[FILE:"), F.lit("")), F.lit("]"), F.lit("")))


# -- cleaning -------------------------------------------------------------

def kb_clean(text: Column) -> Column:
    c = strip(F.replace(text, F.lit("\x00"), F.lit("")))
    c = F.regexp_replace(c, r"\r\n|\r", "\n")
    return strip(replace_all(collapse_blank(c), KB_NOISE))


def kb_reject_reason(raw: Column, clean: Column, min_chars: int = K.KB_MIN_CHARS) -> Column:
    """Why a cleaned knowledge-base text is refused; null when it is accepted."""
    return (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(F.length(clean) < min_chars, "too_short")
        .when(~clean.rlike("[a-zA-Z0-9]{3,}"), "no_tokens")
    )


def email_clean(raw: Column) -> Column:
    c = replace_all(strip(F.coalesce(raw, F.lit(""))), EMAIL_NOISE)
    return strip(collapse_blank(c))


def truncate(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def mask_pii(text: Column, mode: str = "strict") -> Column:
    c = F.coalesce(text, F.lit(""))
    extra = {"strict": PII_STRICT, "relaxed": PII_RELAXED}.get(mode, ())
    for pattern, label in PII_MASKS + extra:
        c = F.regexp_replace(c, pattern, label)
    return strip(F.substring(c, 1, STRICT_CHARS) if mode == "strict" else c)


def clean_short(c: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "), 1, n)


def key_point_lines(c: Column) -> Column:
    lines = F.split(F.coalesce(c, F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]")
    return F.filter(F.transform(lines, strip), lambda s: F.length(s) > 0)


def key_points_piped(c: Column, n: int = K.KEY_POINTS_CHARS) -> Column:
    lines = key_point_lines(c)
    joined = F.concat(F.lit("Key constraints: "), F.array_join(lines, " | "))
    return clean_short(F.when(F.size(lines) > 0, joined).otherwise(""), n)


def key_points_plain(c: Column, n: int = K.KEY_POINTS_CHARS) -> Column:
    return clean_short(F.array_join(key_point_lines(c), " "), n)


def query_text(summary: Column, key_details: Column, ops_query: Column, key_points: Column) -> Column:
    """Search text of a ticket. A null summary means there is no summary; an
    empty one still takes its place (and leaves a leading space)."""
    details = F.array_join(
        F.filter(F.transform(key_details, strip), lambda d: F.length(d) > 0), " "
    )
    points = F.when(F.length(key_points) > 0, strip(key_points))
    with_summary = F.concat_ws(" ", summary, F.nullif(details, F.lit("")), points)
    without = F.concat_ws(" ", F.nullif(ops_query, F.lit("")), points)
    return F.when(summary.isNotNull(), with_summary).otherwise(without)


def length_gate(
    text: Column, email_len: Column, limit: int = K.TOTAL_CHARS, long_email: int = K.LONG_EMAIL_CHARS
) -> Column:
    """Struct of the bounded text, the overflow flag and its reason."""
    too_long = F.length(text) > limit
    reason = F.when(
        too_long,
        F.when(email_len > long_email, "past_email_length_too_long")
        .otherwise("attachment(s)_text_length_too_long"),
    ).otherwise("")
    return F.struct(
        F.substring(text, 1, limit).alias("text"),
        too_long.alias("too_long"),
        reason.alias("reason"),
        email_len.alias("email_len"),
        (F.length(text) - email_len).alias("attachments_len"),
    )


# -- names, addresses, hashes ---------------------------------------------

def safe_file_name(name: Column) -> Column:
    c = F.replace(F.regexp_extract(name, "[^/]*$", 0), F.lit(".."), F.lit(""))
    c = F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")
    return F.lower(F.regexp_replace(c, "_+", "_"))


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(name, r"^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$", 1))


def file_stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_extension(name)))


def url_list(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(https?://[^\s]+)"), F.lit(1)))


def pseudonymise_ip(ip: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), ip), 256)


def clean_id(c: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` of an id; null when nothing is left."""
    return F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""), F.lit(""))


def guard_formula(c: Column) -> Column:
    """Neutralise cells a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


# -- structured text ------------------------------------------------------

def title_case(c: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), ""
    )


def policy_text(json_text: Column) -> Column:
    """Readable lines of a flat policy object, in key order."""
    entries = F.map_entries(F.from_json(json_text, "map<string,string>"))

    def scalar(v):
        v = F.coalesce(v, F.lit("None"))
        return F.when(v == "true", "True").when(v == "false", "False").otherwise(v)

    def line(e):
        title = title_case(F.replace(e["key"], F.lit("_"), F.lit(" ")))
        items = F.transform(F.from_json(e["value"], "array<string>"), lambda i: F.concat(F.lit("- "), scalar(i)))
        listed = F.array_join(F.concat(F.array(F.concat(title, F.lit(":"))), items), "\n")
        return F.when(e["value"].startswith("["), listed).otherwise(
            F.concat(title, F.lit(": "), scalar(e["value"]))
        )

    return F.array_join(F.transform(entries, line), "\n")


def json_block(text: Column) -> Column:
    """First balanced ``{...}`` of the text (quotes are not interpreted).

    Only the braces matter for the balance, so the running depth is folded over
    the pieces between closing braces, not over single characters."""
    start = F.locate("{", text)
    pieces = F.split(F.substring(text, start, F.length(text)), r"\}")

    def opens(p):
        return F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))

    zero = F.struct(
        F.lit(0).alias("i"), F.lit(0).cast("int").alias("depth"), F.lit(0).cast("int").alias("found")
    )

    def step(acc, p):
        depth = acc["depth"] + opens(p) - 1
        done = (acc["found"] == 0) & (depth == 0)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            depth.alias("depth"),
            F.when(done, acc["i"] + 1).otherwise(acc["found"]).alias("found"),
        )

    # The piece after the last closing brace has no brace of its own.
    closed = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    found = F.aggregate(closed, zero, step)["found"]
    return F.when(
        (start > 0) & (found > 0), F.concat(F.array_join(F.slice(pieces, 1, found), "}"), F.lit("}"))
    )


SUMMARY_SCHEMA = "struct<summary:string,key_details:array<string>>"


def parse_model_output(raw: Column, max_details: int = K.MAX_KEY_DETAILS) -> Column:
    """Struct of summary, key details, the path that produced them and validity."""
    whole = strip(raw)
    block = json_block(whole)
    block_ok = F.get_json_object(block, "$").isNotNull()
    # A strict parse fails on trailing text: then the first object ends before the text does.
    is_json = (
        whole.startswith("{")
        & F.get_json_object(whole, "$").isNotNull()
        & ~(F.coalesce(block_ok, F.lit(False)) & (F.length(block) < F.length(whole)))
    )
    path = F.when(is_json, "json").when(block_ok, "block").otherwise("lines")
    source = F.when(is_json, whole).when(block_ok, block)
    parsed = F.from_json(source, SUMMARY_SCHEMA)
    listed = F.coalesce(F.get_json_object(source, "$.key_details"), F.lit("[]")).startswith("[")

    lines = F.filter(F.transform(F.split(whole, "\n"), strip), lambda s: F.length(s) > 0)
    bullets = F.transform(
        F.slice(lines, 2, max_details), lambda s: strip(F.regexp_replace(s, r"(?U)^[-•\d\.\)]\s*", ""))
    )
    details = F.filter(
        F.transform(F.coalesce(parsed["key_details"], F.array().cast("array<string>")), strip),
        lambda s: F.length(s) > 0,
    )
    summary = F.when(path == "lines", F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).otherwise(
        strip(F.coalesce(parsed["summary"], F.lit("")))
    )
    return F.struct(
        summary.alias("summary"),
        F.when(path == "lines", bullets).otherwise(F.slice(details, 1, max_details)).alias("key_details"),
        path.alias("parse_path"),
        ((F.length(summary) > 0) & ((path == "lines") | listed)).alias("is_valid"),
    )


# -- HTML -----------------------------------------------------------------

# Markup that separates text nodes: scripts and styles with their content,
# comments, declarations and tags.
MARKUP = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>"
    r"|<!--.*?-->|<[!?][^>]*>|</?[a-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
)
NODE_BREAK = "\x01"


def _named_entities() -> Column:
    """Names as the HTML standard spells them: with their semicolon, and the
    old ones without it too."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")  # one folded literal


def unescape_html(c: Column, named: Column | None = None) -> Column:
    """Resolve character references. The text is cut before each ``&``, so the
    work per row is linear and stays in the JVM."""
    named = _named_entities() if named is None else named

    def piece(p):
        ref = F.regexp_extract(p, r"^&(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][a-zA-Z0-9]*;?)", 1)
        rest = F.substring(p, F.length(ref) + 2, F.length(p))
        digits = F.regexp_extract(ref, "^#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        value = F.when(ref.startswith("#"), char).otherwise(F.try_element_at(named, ref))
        return F.when(F.length(ref) > 0, F.coalesce(F.concat(value, rest), p)).otherwise(p)

    resolved = F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")
    return F.when(c.contains("&"), resolved).otherwise(c)


def html_text(page: Column) -> Column:
    """Text nodes of a page, one per line, as a lenient HTML parser reports them."""
    c = F.regexp_replace(page, MARKUP, NODE_BREAK)
    # White space between two tags is one node: a line feed if it has one, else a space.
    c = F.regexp_replace(c, "\x01[ \\t\\r\\f]*\\n[ \\t\\r\\n\\f]*(?=\x01)", "\x01\n")
    c = F.regexp_replace(c, "\x01[ \\t\\r\\f]+(?=\x01)", "\x01 ")
    c = F.regexp_replace(c, "\x01+", "\n")
    return strip(unescape_html(c))


def url_file_name(url: Column) -> Column:
    c = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.replace(c, F.lit("/"), F.lit("_"))
