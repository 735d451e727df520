"""Text preparation and rule queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark import constants as K
from kbspark.catalog import fixtures as X
from kbspark.catalog import sqlkit as Q
from kbspark.catalog.fixtures import sql, table
from kbspark.functions import rules as R
from kbspark.functions import text as T
from kbspark.functions import urls as U
from kbspark.operators import chunking

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def doc_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.chunk(docs)


@query("chunk_text", sql("SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM chunks"))
def chunk_text(spark, sf_dir):
    return doc_chunks(spark, sf_dir)


_HEADER = "'[SOURCE:KB] [FILE:' || doc_id || '.txt] [CHUNK:' || chunk_index || ']'"


@query("chunk_header", sql(f"""SELECT {_HEADER} || '\n' || text AS chunk, 'KB' AS source, doc_id || '.txt' AS file_name,
    CAST(chunk_index AS INTEGER) AS chunk_index, text FROM chunks"""))
def chunk_header(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    built = doc_chunks(spark, sf_dir).select(
        T.chunk_with_header(F.lit("KB"), name, F.col("chunk_index"), F.col("text")).alias("chunk")
    )
    return built.select("chunk", T.parse_chunk(F.col("chunk")).alias("p")).select("chunk", "p.*")


@query("kb_text_sanitize", sql(f"""SELECT doc_id, clean_text, CASE WHEN text = '' THEN 'empty'
    WHEN length(clean_text) < 100 THEN 'too_short'
    WHEN NOT regexp_matches(clean_text, '[a-zA-Z0-9]{{3,}}') THEN 'no_tokens' ELSE '' END AS reject_reason
    FROM (SELECT doc_id, text, {Q.kb_clean('text')} AS clean_text FROM documents)"""))
def kb_text_sanitize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = docs.withColumn("clean_text", T.kb_clean(F.col("text")))
    reason = F.coalesce(T.kb_reject_reason(F.col("text"), F.col("clean_text")), F.lit(""))
    return cleaned.select("doc_id", "clean_text", reason.alias("reject_reason"))


@query("email_thread_clean", sql(f"SELECT conv_id, turn, {Q.email_clean('body')} AS clean_text FROM messages"))
def email_thread_clean(spark, sf_dir):
    return X.messages(spark, sf_dir).select("conv_id", "turn", T.email_clean(F.col("body")).alias("clean_text"))


@query("truncate_fields", sql("""SELECT doc_id, substring(text, 1, 5000) AS email, substring(text, 1, 4000) AS attachment,
    substring(text, 1, 300) AS purpose, substring(text, 1, 1000) AS key_points FROM documents"""))
def truncate_fields(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.truncate(t, K.EMAIL_CHARS).alias("email"),
        T.truncate(t, K.ATTACHMENT_CHARS).alias("attachment"),
        T.truncate(t, K.PURPOSE_CHARS).alias("purpose"),
        T.truncate(t, K.KEY_POINTS_CHARS).alias("key_points"),
    )


@query("mask_pii_strict", sql(f"SELECT doc_id, {Q.mask('text', 'strict')} AS masked FROM documents"))
def mask_pii_strict(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_pii(F.col("text")).alias("masked"))


@query("mask_pii_relaxed", sql(f"SELECT doc_id, {Q.mask('text', 'relaxed')} AS masked FROM documents"))
def mask_pii_relaxed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_pii(F.col("text"), "relaxed").alias("masked"))


@query("clean_short_text", sql(f"""SELECT conv_id, turn, {Q.short('text', K.PURPOSE_CHARS)} AS purpose,
    {Q.short('text', K.KEY_POINTS_CHARS)} AS key_points FROM conversations"""))
def clean_short_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        T.clean_short(F.col("text"), K.PURPOSE_CHARS).alias("purpose"),
        T.clean_short(F.col("text"), K.KEY_POINTS_CHARS).alias("key_points"),
    )


_LINES = (
    f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {Q.strip('s')}), lambda s: length(s) > 0)"
)


@query("key_points_format", sql(f"""SELECT conv_id, turn,
    CASE WHEN len(l) > 0 THEN {Q.short("'Key constraints: ' || array_to_string(l, ' | ')", K.KEY_POINTS_CHARS)}
         ELSE '' END AS piped, {Q.short("array_to_string(l, ' ')", K.KEY_POINTS_CHARS)} AS plain
    FROM (SELECT conv_id, turn, {_LINES} AS l FROM conversations)"""))
def key_points_format(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        T.key_points_piped(F.col("text")).alias("piped"),
        T.key_points_plain(F.col("text")).alias("plain"),
    )


@query("build_query_text", sql("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0
    THEN summary || CASE WHEN details = '' THEN '' ELSE ' ' || details END
    ELSE text END || CASE WHEN points = '' THEN '' ELSE ' ' || points END AS query_text
    FROM (SELECT conv_id, turn, text, CASE WHEN conv_id % 5 = 0 THEN '' ELSE string_split(text, '.')[1] END AS summary,
        array_to_string(list_filter(list_transform(string_split(text, '. '), lambda d: trim(d, chr(10)||' ')),
            lambda d: length(d) > 0), ' ') AS details,
        CASE WHEN conv_id % 2 = 0 THEN 'refund window' ELSE '' END AS points FROM conversations)"""))
def build_query_text(spark, sf_dir):
    t, c = F.col("text"), F.col("conv_id")
    summary = F.when(F.col("turn") % 2 == 0, F.when(c % 5 == 0, "").otherwise(F.substring_index(t, ".", 1)))
    points = F.when(c % 2 == 0, "refund window").otherwise("")
    details = F.split(t, "[.] ")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.query_text(summary, details, t, points).alias("query_text")
    )


@query("text_length_gate", sql(f"""SELECT doc_id, substring(text, 1, 12000) AS text, length(text) > 12000 AS too_long,
    CASE WHEN length(text) <= 12000 THEN '' WHEN length(text) // 3 > 3000 THEN 'past_email_length_too_long'
         ELSE 'attachment(s)_text_length_too_long' END AS reason,
    CAST(length(text) // 3 AS INTEGER) AS email_len,
    CAST(length(text) - length(text) // 3 AS INTEGER) AS attachments_len FROM documents"""))
def text_length_gate(spark, sf_dir):
    email_len = F.floor(F.length("text") / 3).cast("int")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.length_gate(F.col("text"), email_len).alias("g")).select("doc_id", "g.*")


_CHARS = "SELECT conv_id, turn, raw, i, substring(raw, i, 1) AS ch FROM (SELECT *, unnest(range(instr(raw, '{'), length(raw) + 1)) AS i FROM trimmed WHERE instr(raw, '{') > 0)"
_DEPTH = "SELECT *, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS depth FROM chars"
_BLOCKS = "SELECT conv_id, turn, substring(any_value(raw), instr(any_value(raw), '{'), min(i) - instr(any_value(raw), '{') + 1) AS block FROM depths WHERE ch = '}' AND depth = 0 GROUP BY conv_id, turn"
_PARSED = f"""SELECT conv_id, turn, CASE WHEN json_valid(raw) THEN 'json' WHEN block IS NOT NULL AND json_valid(block) THEN 'block'
    ELSE 'lines' END AS parse_path, CASE WHEN json_valid(raw) THEN raw ELSE block END AS j,
    list_filter(list_transform(string_split(raw, chr(10)), lambda s: {Q.strip('s')}), lambda s: length(s) > 0) AS l
    FROM trimmed LEFT JOIN blocks USING (conv_id, turn)"""


@query("parse_model_output", sql(f"""SELECT conv_id, turn, summary, array_to_string(details, '|') AS key_details, parse_path,
    length(summary) > 0 AS is_valid FROM (SELECT conv_id, turn, parse_path,
    CASE parse_path WHEN 'lines' THEN coalesce(l[1], '') ELSE {Q.strip("coalesce(j->>'$.summary', '')")} END AS summary,
    CASE parse_path WHEN 'lines' THEN list_transform(l[2:8],
        lambda s: {Q.strip("regexp_replace(s, '^[-•" + chr(92) + "d" + chr(92) + "." + chr(92) + ")]" + chr(92) + "s*', '')")})
    ELSE list_filter(list_transform(CAST(j->'$.key_details' AS VARCHAR[]), lambda s: {Q.strip('s')}),
        lambda s: length(s) > 0)[1:7] END AS details FROM parsed)""",
    trimmed=f"SELECT conv_id, turn, {Q.strip('raw')} AS raw FROM model_outputs",
    chars=_CHARS, depths=_DEPTH, blocks=_BLOCKS, parsed=_PARSED))
def parse_model_output(spark, sf_dir):
    out = X.model_outputs(spark, sf_dir).select("conv_id", "turn", T.parse_model_output(F.col("raw")).alias("p"))
    return out.select(
        "conv_id", "turn", "p.summary", F.array_join("p.key_details", "|").alias("key_details"),
        "p.parse_path", "p.is_valid",
    )


@query("file_name_sanitize", sql(f"SELECT page_id, {Q.safe_file_name('url')} AS safe_name FROM pages"))
def file_name_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("safe_name"))


@query("url_extract", sql(r"""SELECT doc_id, unnest(list_distinct(regexp_extract_all(content, 'https?://[^\s]+'))) AS url
    FROM url_docs"""))
def url_extract(spark, sf_dir):
    return X.url_docs(spark, sf_dir).select("doc_id", F.explode(T.url_list(F.col("content"))).alias("url"))


@query("pseudonymize_ip", sql("SELECT event_id, sha256('pepper:' || ip) AS ip_hash FROM request_log"))
def pseudonymize_ip(spark, sf_dir):
    return X.request_log(spark, sf_dir).select("event_id", T.pseudonymise_ip(F.col("ip"), "pepper").alias("ip_hash"))


@query("content_hash_check", sql("""SELECT doc_id, sha256(content) AS server_hash,
    client_hash IS NOT NULL AND client_hash <> sha256(content) AS mismatch FROM kb_manifest"""))
def content_hash_check(spark, sf_dir):
    server = F.sha2("content", 256)
    return X.kb_manifest(spark, sf_dir).select(
        "doc_id", server.alias("server_hash"),
        F.coalesce(F.col("client_hash") != server, F.lit(False)).alias("mismatch"),
    )


@query("source_files_list", sql("SELECT DISTINCT doc_id || '.txt' AS file_name FROM chunks"))
def source_files_list(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    header = T.chunk_header(F.lit("KB"), name, F.col("chunk_index"))
    files = doc_chunks(spark, sf_dir).select(F.explode(T.header_file(header)).alias("file_name"))
    return files.distinct()


@query("interaction_id_clean", sql(
    r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g') AS interaction_id FROM pages"))
def interaction_id_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_id(F.col("url")).alias("interaction_id"))


@query("chunk_preview", sql("SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, substring(text, 1, 200) AS preview FROM chunks"))
def chunk_preview(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", "chunk_index", T.preview(F.col("text")).alias("preview"))


# -- rules ----------------------------------------------------------------

@query("meaningful_text", sql(f"SELECT doc_id, {Q.meaningful('text')} AS meaningful FROM documents"))
def meaningful_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.meaningful_text(F.col("text")).alias("meaningful"))


FILE_CODE = """CASE WHEN file_name = '' THEN 'MISSING_FILE_NAME'
    WHEN lower(regexp_extract(file_name, '[.][^.]*$')) NOT IN ('.txt', '.pdf', '.json') THEN 'UNSUPPORTED_FILE_TYPE'
    WHEN size_bytes > 5242880 THEN 'FILE_TOO_LARGE' ELSE '' END"""


@query("file_admission", sql(f"SELECT doc_id, {FILE_CODE} AS code FROM kb_manifest"))
def file_admission(spark, sf_dir):
    code = R.file_rejection(F.col("file_name"), F.col("size_bytes"))
    return X.kb_manifest(spark, sf_dir).select("doc_id", F.coalesce(code, F.lit("")).alias("code"))


@query("url_safety", sql("""SELECT page_id, url, regexp_matches(lower(url), '^https?://') AND host <> ''
    AND NOT regexp_matches(host, '^(10[.]|127[.]|169[.]254[.]|240[.]|192[.]168[.]|::1)') AS safe,
    regexp_matches(lower(url), '^https?://') AND host <> '' AND ends_with(host, 'example.com') AS in_domain
    FROM hosts""", hosts=r"""SELECT page_id, url, resolved_ips, lower(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), '^\[([^\]]*)\].*', '\1'), '^([^:]+):\d+$', '\1')) AS host FROM url_probe"""))
def url_safety(spark, sf_dir):
    u = F.col("url")
    return X.url_probe(spark, sf_dir).select(
        "page_id", "url", U.is_safe_url(u).alias("safe"), U.is_safe_url(u, ["example.com"]).alias("in_domain")
    )


@query("url_blocked_host", sql("""SELECT page_id, coalesce(host NOT IN ('', 'localhost', '127.0.0.1', '0.0.0.0', '169.254.169.254')
    AND len(list_filter(resolved_ips, lambda i: starts_with(i, '10.') OR starts_with(i, 'fe80'))) = 0, false) AS public
    FROM hosts""", hosts=r"""SELECT page_id, url, resolved_ips, lower(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), '^\[([^\]]*)\].*', '\1'), '^([^:]+):\d+$', '\1')) AS host FROM url_probe"""))
def url_blocked_host(spark, sf_dir):
    return X.url_probe(spark, sf_dir).select(
        "page_id", U.is_public_host(F.col("url"), F.col("resolved_ips")).alias("public")
    )


@query("page_admission", sql("""SELECT page_id, content_length, redirects, content_type FROM url_probe
    WHERE content_length <= 2000000 AND redirects <= 3 AND (starts_with(content_type, 'text/') OR contains(content_type, 'html'))"""))
def page_admission(spark, sf_dir):
    probe = X.url_probe(spark, sf_dir).select(
        "page_id", "content_length", F.col("redirects").cast("bigint").alias("redirects"), "content_type")
    return probe.filter(U.is_admitted_page(F.col("content_length"), F.col("redirects"), F.col("content_type")))


TRUTHY = "lower(CAST({c} AS VARCHAR)) IN ('true', '1', 'yes')"
WORKFLOW = "CASE " + " ".join(f"WHEN {TRUTHY.format(c=k)} THEN '{v}'" for k, v in K.WORKFLOWS) + " END"


def workflow_of(frame):
    return R.workflow({key: F.col(key) for key, _ in K.WORKFLOWS})


@query("truthy_parse", sql("SELECT ticket_id, " + ", ".join(f"{TRUTHY.format(c=k)} AS {k}" for k, _ in K.WORKFLOWS) + " FROM tickets"))
def truthy_parse(spark, sf_dir):
    return X.tickets(spark, sf_dir).select("ticket_id", *[R.truthy(F.col(k)).alias(k) for k, _ in K.WORKFLOWS])


@query("workflow_resolve", sql(f"SELECT ticket_id, coalesce({WORKFLOW}, 'none') AS workflow_type FROM tickets"))
def workflow_resolve(spark, sf_dir):
    t = X.tickets(spark, sf_dir)
    return t.select("ticket_id", F.coalesce(workflow_of(t), F.lit("none")).alias("workflow_type"))


@query("keyword_risk", sql(f"SELECT doc_id, coalesce({Q.keyword_hit('text')}, '') AS keyword FROM documents"))
def keyword_risk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(R.keyword_hit(F.col("text")), F.lit("")).alias("keyword"))


def gate_sql(email: str) -> str:
    """Input checks over columns purpose, wf, raw_email, {email}, query."""
    support = "wf = 'support_agent_assistance'"
    raw = f"length({Q.strip('coalesce(raw_email, chr(32))')})"
    q = f"length({Q.strip('coalesce(query, chr(32))')})"
    rules = [
        (f"length({Q.strip('purpose')}) < 5", "REJECT", "purpose_required"),
        ("wf IS NULL", "REJECT", "no_workflow"),
        (f"{support} AND {raw} = 0", "REJECT", "past_email_required"),
        (f"{support} AND {raw} > 5 AND NOT {Q.meaningful(email)}", "REJECT", "insufficient_information"),
        (f"NOT {support} AND {q} < 5", "REJECT", "query_required"),
        (f"NOT {support} AND length(query) > 200", "ESCALATE", "ops_query_too_long"),
    ]
    status = " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in rules)
    reason = " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in rules)
    return f"CASE {status} ELSE 'PASS' END AS gate_status, CASE {reason} ELSE '' END AS gate_reason"


@query("ticket_input_gate", sql(f"""SELECT ticket_id, {gate_sql('email')} FROM (SELECT *, {WORKFLOW} AS wf,
    past_email AS raw_email, substring({Q.email_clean("coalesce(past_email, '')")}, 1, 5000) AS email FROM tickets)"""))
def ticket_input_gate(spark, sf_dir):
    t = X.tickets(spark, sf_dir)
    email = T.truncate(T.email_clean(F.col("past_email")), K.EMAIL_CHARS)
    gate = R.ticket_gate(F.col("purpose"), workflow_of(t), F.col("past_email"), email, F.col("query"))
    return t.select("ticket_id", gate.alias("g")).select("ticket_id", "g.*")


_COMMENT = "CASE event_id % 4 WHEN 0 THEN '  late' || chr(10) || 'parcel ' || chr(9) WHEN 1 THEN ' ' || chr(13) || chr(10) WHEN 2 THEN 'fine' END"


@query("feedback_bucket", sql(f"""SELECT event_id, rating, CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral'
    ELSE 'needs_review' END AS feedback_type, nullif({Q.strip(_COMMENT)}, '') AS comment FROM request_log WHERE rating BETWEEN 1 AND 5"""))
def feedback_bucket(spark, sf_dir):
    rated = X.request_log(spark, sf_dir).filter(F.col("rating").between(1, 5))
    return rated.select("event_id", F.col("rating").cast("bigint"), R.feedback_bucket(F.col("rating")).alias("feedback_type"),
                        R.feedback_comment(F.expr(_COMMENT)).alias("comment"))


_INTENT = X.sql_pick("doc_id % 5", *map(Q.lit, K.INTENT_LABELS))


@query("tone_rule", sql(f"""SELECT doc_id, CASE WHEN quality = 0 AND {_INTENT} IN ('complaint', 'technical_issue', 'refund_request')
    THEN 'empathetic' WHEN quality = 0 THEN 'professional' ELSE 'neutral' END AS tone FROM labels"""))
def tone_rule(spark, sf_dir):
    label = F.when(F.col("quality") == 0, "negative").when(F.col("toxic") == 1, "").otherwise("POSITIVE")
    intent = X.pick(F.col("doc_id") % 5, *K.INTENT_LABELS)
    return table(spark, sf_dir, "labels").select("doc_id", R.tone(F.lit("neutral"), label, intent).alias("tone"))


@query("stale_event_filter", sql("""SELECT event_id, us FROM request_log
    WHERE abs((epoch_us(seen_ts) // 1000000) - (us // 1000000)) <= 300"""))
def stale_event_filter(spark, sf_dir):
    log = X.request_log(spark, sf_dir)
    return log.filter(R.within_skew(F.col("ts"), F.col("seen_ts"))).select("event_id", "us")


@query("sink_csv_guarded", sql("""SELECT doc_id, CASE WHEN regexp_matches(cell, '^[=+@-]') THEN '''' || cell ELSE cell END AS cell
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END
        || replace(replace(text, chr(10), ' '), chr(13), ' ') AS cell FROM documents)"""))
def sink_csv_guarded(spark, sf_dir):
    from kbspark.session import work_dir
    from kbspark.sources import sinks

    flat = F.translate("text", "\n\r", "  ")
    cells = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(X.pick(F.col("doc_id") % 5, "=", "+", "-", "@", ""), flat).alias("cell"))
    path = work_dir(spark, "guarded-csv")
    sinks.write_csv_guarded(cells, path)
    return sinks.read_csv(spark, path, cells.schema)
