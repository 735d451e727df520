"""Inputs of the registered queries, derived from the given tables by column
arithmetic, once for Spark and once (``CTES``) for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbspark import constants as K
from kbspark.catalog import sqlkit as Q
from kbspark.session import balanced, ensure_utc


HEAVY = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; those with long texts are spread when they are one small file."""
    rows = ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(rows, *HEAVY[name]) if name in HEAVY else rows


def pick(index: Column, *values) -> Column:
    """The value at position ``index`` of a short list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def sql_pick(index: str, *values: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# -- knowledge base -------------------------------------------------------

def kb_files(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("doc"), (d - F.when(d % 8 == 1, 1).otherwise(0)).cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        name.alias("file_name"),
        F.when(d % 4 == 0, "UPLOADED_KB").otherwise("KB").alias("source"),
        F.col("text").alias("content"),
    )


KB_FILES = """SELECT doc_id, 'doc' || (doc_id - CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END) || '.txt' AS file_name,
    CASE WHEN doc_id % 4 = 0 THEN 'UPLOADED_KB' ELSE 'KB' END AS source, text AS content FROM documents"""


def kb_manifest(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("F "), d.cast("string"), pick(d % 4, ".TXT", ".pdf", ".json", ".exe"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 97 == 5, "").otherwise(name).alias("file_name"),
        (F.col("n_chars") * 1000).alias("size_bytes"),
        (d % 7 == 0).alias("overwrite"),
        F.when(d % 5 == 0, F.sha2("text", 256)).when(d % 5 == 1, "bad").alias("client_hash"),
        F.col("text").alias("content"),
    )


KB_MANIFEST = f"""SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN '' ELSE 'F ' || doc_id ||
    {sql_pick('doc_id % 4', "'.TXT'", "'.pdf'", "'.json'", "'.exe'")} END AS file_name,
    n_chars * 1000 AS size_bytes, doc_id % 7 = 0 AS overwrite,
    CASE WHEN doc_id % 5 = 0 THEN sha256(text) WHEN doc_id % 5 = 1 THEN 'bad' END AS client_hash,
    text AS content FROM documents"""


def existing_files(spark, sf_dir) -> DataFrame:
    """Cleaned files already in the knowledge base: every third document."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f_"), d.cast("string"), F.when(d % 3 == 0, ".txt").otherwise(".old")).alias("file_name")
    )


EXISTING_FILES = """SELECT 'f_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.old' END AS file_name
    FROM documents"""


def policy_json(spark, sf_dir) -> DataFrame:
    doc = F.concat(
        F.lit('{"refund_window":'), F.col("n_chars").cast("string"),
        F.lit(',"lang_list":["'), F.col("lang"), F.lit('","all"],"source_name":"'), F.col("source"),
        F.lit('","is_public":'), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("null"), F.lit("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", doc.alias("policy"))


def url_docs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    d = F.col("doc_id")
    n_pages = pages.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    numbered = docs.withColumn("page", d % n_pages)
    joined = numbered.join(pages, F.col("page_id") == F.col("page"), "left")
    link = F.concat(F.lit(" see "), F.col("url"), F.lit(" or "), F.col("url"))
    linked = F.concat("text", F.when(d % 3 == 0, F.coalesce(link, F.lit(""))).otherwise(""))
    return joined.select(
        "doc_id",
        F.concat(F.lit("doc"), d.cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit("KB").alias("source"),
        linked.alias("content"),
    )


URL_DOCS = """SELECT doc_id, 'doc' || doc_id || '.txt' AS file_name, 'KB' AS source,
    text || CASE WHEN doc_id % 3 = 0 THEN coalesce(' see ' || url || ' or ' || url, '') ELSE '' END AS content
    FROM (SELECT *, doc_id % (SELECT greatest(count(*), 1) FROM pages) AS page FROM documents) LEFT JOIN pages ON page_id = page"""

HOSTS = (
    "10.0.0.1", "127.0.0.1", "169.254.169.254", "240.0.0.1", "[::1]", "localhost", "LOCALHOST",
    "user@192.168.1.9:8080", "evilexample.com", "8.8.8.8", "[2606:4700::1111]", "Sub.Example.COM", "",
)


def url_probe(spark, sf_dir) -> DataFrame:
    """Crawl metadata: the page's own address, or one with a probing host."""
    p = F.col("page_id")
    host = pick(p % len(HOSTS), *HOSTS)
    probing = F.concat(pick(p % 4, "http", "HTTPS", "ftp", "https"), F.lit("://"), host, F.lit("/p/"), p.cast("string"))
    ips = F.when(p % 5 == 0, F.array(F.lit("10.1.2.3"))).when(
        p % 5 == 1, F.array(F.lit("93.184.216.34"), F.lit("fe80::1"))
    ).when(p % 5 == 2, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("93.184.216.34")))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(p % 3 == 0, F.col("url")).otherwise(probing).alias("url"),
        ips.alias("resolved_ips"),
        (F.length("html") * 200).cast("bigint").alias("content_length"),
        (p % 5).cast("int").alias("redirects"),
        pick(p % 4, "text/html; charset=utf-8", "application/pdf", "application/xhtml+xml", "text/plain").alias("content_type"),
    )


URL_PROBE = f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE
    {sql_pick('page_id % 4', "'http'", "'HTTPS'", "'ftp'", "'https'")} || '://' ||
    {sql_pick(f'page_id % {len(HOSTS)}', *map(Q.lit, HOSTS))} || '/p/' || page_id END AS url,
    CASE page_id % 5 WHEN 0 THEN ['10.1.2.3'] WHEN 1 THEN ['93.184.216.34', 'fe80::1']
        WHEN 2 THEN NULL ELSE ['93.184.216.34'] END AS resolved_ips,
    length(html) * 200 AS content_length, page_id % 5 AS redirects,
    {sql_pick('page_id % 4', "'text/html; charset=utf-8'", "'application/pdf'", "'application/xhtml+xml'", "'text/plain'")}
        AS content_type FROM pages"""


# -- conversations: e-mail, attachments, model outputs --------------------

def messages(spark, sf_dir) -> DataFrame:
    """Every turn as one message: user turns carry thread noise, by kind."""
    t, c, n = F.col("text"), F.col("conv_id"), F.col("turn")
    noisy = with_noise(t, (c + n) % 4)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "user", noisy).otherwise(t).alias("body"),
        F.concat(F.lit("note "), n.cast("string"), pick((c * 3 + n) % 9, *(".txt",) * 7, ".PDF", ".doc")).alias("file_name"),
        (F.length(t) * pick((c + n) % 6, 1, 1, 1, 1, 1, 9000)).cast("bigint").alias("size_bytes"),
    )


def with_noise(t: Column, kind: Column) -> Column:
    """A message as a mail program leaves it: plain, quoting, signed or with a greeting."""
    return pick_text(kind, [
        t,
        F.concat(F.lit("On Mon X wrote:\n> "), F.substring_index(t, " ", 3), F.lit("\n"), t),
        F.concat(t, F.lit("\n--\nSig\nFrom: me")),
        F.concat(t, F.lit("\nThanks,\nBob")),
    ])


def emails(spark, sf_dir) -> DataFrame:
    """One mail per conversation: all its user turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    threads = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda r: r["text"]), "\n").alias("text"))
    return threads.select(F.col("conv_id").alias("ticket_id"), with_noise(F.col("text"), F.col("conv_id") % 4).alias("body"))


def pick_text(index: Column, options: list[Column]) -> Column:
    chain = F.when(index == 0, options[0])
    for i, o in enumerate(options[1:], start=1):
        chain = chain.when(index == i, o)
    return chain


NOISY = ("text", "'On Mon X wrote:\n> ' || array_to_string(string_split(text, ' ')[1:3], ' ') || '\n' || text",
         "text || '\n--\nSig\nFrom: me'", "text || '\nThanks,\nBob'")
EMAILS = f"""SELECT conv_id AS ticket_id, {sql_pick('conv_id % 4', *NOISY)} AS body FROM
    (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text), '') AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)"""
MESSAGES = f"""SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN text ELSE
    {sql_pick('(conv_id + turn) % 4', *NOISY)} END AS body,
    'note ' || turn || {sql_pick('(conv_id * 3 + turn) % 9', *["'.txt'"] * 7, "'.PDF'", "'.doc'")} AS file_name,
    length(text) * {sql_pick('(conv_id + turn) % 6', '1', '1', '1', '1', '1', '9000')} AS size_bytes
    FROM conversations"""


def model_outputs(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    first = F.substring_index(t, "\n", 1)
    obj = F.to_json(F.struct(
        first.alias("summary"), F.split(t, "[.] ").alias("key_details")
    ))
    lines = F.concat(first, F.lit("\n- "), F.array_join(F.split(t, "[.] "), "\n• "), F.lit("\n2) last"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        pick_text(F.col("conv_id") % 3, [obj, F.concat(F.lit("Sure: "), obj, F.lit(" done }")), lines]).alias("raw"),
    )


# JSON text is built by each engine; both quote the same way for this data.
MODEL_OUTPUTS = r"""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN obj WHEN 1 THEN 'Sure: ' || obj || ' done }'
    ELSE head || chr(10) || '- ' || array_to_string(parts, chr(10) || '• ') || chr(10) || '2) last' END AS raw
    FROM (SELECT conv_id, turn, string_split(text, chr(10))[1] AS head, string_split(text, '. ') AS parts,
        to_json({'summary': string_split(text, chr(10))[1], 'key_details': string_split(text, '. ')})::VARCHAR AS obj
        FROM conversations)"""


# -- vectors --------------------------------------------------------------

def corpus(spark, sf_dir) -> DataFrame:
    """Every vector as an indexed chunk, with the text of its document."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = F.col("vec_id")
    return e.join(d, d.doc_id == v, "left").select(
        v.alias("chunk_id"),
        F.when(v % 4 == 0, "UPLOADED_KB").otherwise("KB").alias("source"),
        F.concat(F.lit("doc"), v.cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit(0).alias("chunk_index"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        "embedding",
    )


CORPUS = """SELECT vec_id AS chunk_id, CASE WHEN vec_id % 4 = 0 THEN 'UPLOADED_KB' ELSE 'KB' END AS source,
    'doc' || vec_id || '.txt' AS file_name, 0 AS chunk_index, coalesce(text, '') AS text,
    CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id"""


def query_vectors(spark, sf_dir) -> DataFrame:
    """One query per vector: a blend of the vector and its mirror image, from
    far away (weight 0) to close by (weight 0.9)."""
    w = (F.col("vec_id") % 10) / F.lit(10.0)
    e = F.col("embedding").cast("array<double>")
    blend = F.zip_with(e, F.reverse(e), lambda a, b: w * a + (F.lit(1.0) - w) * b)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), blend.alias("vector"))


QUERY_VECTORS = """SELECT vec_id AS query_id, list_transform(list_zip(e, list_reverse(e)),
    lambda p: (vec_id % 10) / 10.0::DOUBLE * p[1] + (1.0::DOUBLE - (vec_id % 10) / 10.0::DOUBLE) * p[2]) AS vector
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


def predictions(spark, sf_dir) -> DataFrame:
    v, y = F.col("vec_id"), F.col("label")
    guess = F.when(v % 4 == 0, (y + 1) % 5).otherwise(y % 5)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", pick(y % 5, *K.INTENT_LABELS).alias("actual"), pick(guess, *K.INTENT_LABELS).alias("predicted")
    )


PREDICTIONS = f"""SELECT vec_id, {sql_pick('label % 5', *map(Q.lit, K.INTENT_LABELS))} AS actual,
    {sql_pick('CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 5 ELSE label % 5 END', *map(Q.lit, K.INTENT_LABELS))}
    AS predicted FROM embeddings"""


def tickets(spark, sf_dir) -> DataFrame:
    """One ticket per vector; its message is the document of the same id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v, t = F.col("vec_id"), F.coalesce(F.col("text"), F.lit(""))
    support = (v % 4) < 2
    risky = F.when(v % 11 == 3, F.concat(F.lit("Chargeback now. "), t)).otherwise(t)
    return e.join(d, d.doc_id == v, "left").select(
        v.alias("ticket_id"),
        pick(v % 9, *("answer the customer",) * 8, " ok ").alias("purpose"),
        pick(v % 4, "true", "YES", "no", "false").alias("support_agent_assistance"),
        (v % 4 == 2).alias("internal_ops"),
        pick(v % 3, "1", "1", "0").alias("financial_ops"),
        pick(v % 5, "0", "1", "1", "1", "1").alias("compliance_validation"),
        F.when(support, F.when(v % 12 == 5, " ").otherwise(risky)).alias("past_email"),
        F.when(~support, risky).alias("query"),
        F.when(v % 6 == 0, "damaged item\n\n refund window ").otherwise("").alias("key_points"),
        pick(v % 5, *K.INTENT_LABELS).alias("intent"),
        (v % 2 == 0).alias("allow_hard_escalate"),
    )


TICKETS = f"""SELECT vec_id AS ticket_id, {sql_pick('vec_id % 9', *["'answer the customer'"] * 8, "' ok '")} AS purpose,
    {sql_pick('vec_id % 4', "'true'", "'YES'", "'no'", "'false'")} AS support_agent_assistance,
    vec_id % 4 = 2 AS internal_ops, {sql_pick('vec_id % 3', "'1'", "'1'", "'0'")} AS financial_ops,
    {sql_pick('vec_id % 5', "'0'", "'1'", "'1'", "'1'", "'1'")} AS compliance_validation,
    CASE WHEN vec_id % 4 < 2 THEN CASE WHEN vec_id % 12 = 5 THEN ' ' ELSE risky END END AS past_email,
    CASE WHEN vec_id % 4 >= 2 THEN risky END AS query,
    CASE WHEN vec_id % 6 = 0 THEN 'damaged item\n\n refund window ' ELSE '' END AS key_points,
    {sql_pick('vec_id % 5', *map(Q.lit, K.INTENT_LABELS))} AS intent, vec_id % 2 = 0 AS allow_hard_escalate
    FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 3 THEN 'Chargeback now. ' || coalesce(text, '')
        ELSE coalesce(text, '') END AS risky FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""


# -- request log ----------------------------------------------------------

ENDPOINT_BY_EVENT = (
    ("view", "api_retrieve"), ("click", "api_predict"), ("purchase", "api_ingest_kb"),
    ("signup", "api_feedback"), ("error", "api_health"),
)


def log_columns(events: DataFrame) -> DataFrame:
    """Request log columns of an events frame (batch or stream)."""
    u, us = F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    endpoint = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ENDPOINT_BY_EVENT])
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        us.alias("us"),
        F.concat(F.lit("k"), (u % 20).cast("string")).alias("api_key"),
        F.concat(F.lit("t"), (u % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("10.0.0."), (u % 37).cast("string")).alias("ip"),
        endpoint.alias("endpoint"),
        F.col("event_type").isin("view", "click").alias("is_llm"),
        (F.col("event_type") == "click").alias("is_capped"),
        F.when(F.col("event_id") % 23 == 0, " ok ").otherwise("answer the customer").alias("purpose"),
        (F.floor("value") % 7).cast("int").alias("rating"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") % 700)).alias("seen_ts"),
    )


def request_log(spark, sf_dir) -> DataFrame:
    return log_columns(table(spark, sf_dir, "events"))


REQUEST_LOG = f"""SELECT event_id, ts, epoch_us(ts) AS us, 'k' || (user_id % 20) AS api_key,
    't' || (user_id % 5) AS tenant_id, '10.0.0.' || (user_id % 37) AS ip,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDPOINT_BY_EVENT)} END AS endpoint,
    event_type IN ('view', 'click') AS is_llm, event_type = 'click' AS is_capped,
    CASE WHEN event_id % 23 = 0 THEN ' ok ' ELSE 'answer the customer' END AS purpose, CAST(floor(value) AS BIGINT) % 7 AS rating,
    ts + to_seconds(event_id % 700) AS seen_ts FROM events"""


def shift_days(log: DataFrame, days: int) -> DataFrame:
    """The log moved in time, so that it crosses a month boundary."""
    return log.withColumns({
        "ts": F.col("ts") + F.make_dt_interval(days=F.lit(days)),
        "us": F.col("us") + days * 86_400_000_000,
    })


SHIFTED_LOG = """SELECT * REPLACE (ts + INTERVAL 15 DAY AS ts, us + 15 * 86400000000 AS us) FROM request_log"""


def api_keys(spark, sf_dir) -> DataFrame:
    """Key registry: one row per key that occurs in the log, but one unknown."""
    n = F.substring("api_key", 2, 9).cast("int")
    scopes = F.array(*map(F.lit, ("retrieve", "predict", "ingest_kb", "feedback", "health")))
    return request_log(spark, sf_dir).select("api_key").distinct().filter("api_key <> 'k19'").select(
        "api_key",
        F.when(n % 6 == 0, F.array_remove(scopes, "predict")).otherwise(scopes).alias("scopes"),
        F.when(n % 9 == 0, "revoked").when(n % 7 == 3, "disabled").otherwise("active").alias("status"),
        (n % 2 == 0).alias("allow_hard_escalate"),
    )


API_KEYS = """SELECT api_key, CASE WHEN n % 6 = 0 THEN ['retrieve', 'ingest_kb', 'feedback', 'health']
        ELSE ['retrieve', 'predict', 'ingest_kb', 'feedback', 'health'] END AS scopes,
    CASE WHEN n % 9 = 0 THEN 'revoked' WHEN n % 7 = 3 THEN 'disabled' ELSE 'active' END AS status,
    n % 2 = 0 AS allow_hard_escalate
    FROM (SELECT DISTINCT api_key, CAST(substring(api_key, 2) AS INTEGER) AS n FROM request_log WHERE api_key <> 'k19')"""


def interaction_states(log: DataFrame) -> DataFrame:
    """State written by each retrieve request; it lives two hours."""
    return log.filter("endpoint = 'api_retrieve'").select(
        F.col("event_id").cast("string").alias("interaction_id"),
        "tenant_id",
        F.concat(F.lit("call +91 98765 43210 or mail a.b@c.org about "), "ip").alias("purpose"),
        F.concat(F.lit("ref AB-"), (F.col("event_id") + 1000).cast("string")).alias("key_points"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("expires_at"),
        F.when(F.col("event_id") % 2 == 0, "customer_support").otherwise("internal_ops").alias("workflow_type"),
        F.concat(F.lit("refund for a.b@c.org, request "), F.col("event_id").cast("string")).alias("ops_query"),
        F.when(F.col("event_id") % 3 != 0, "refund").alias("intent"),
        (F.col("event_id") % 3 != 0).alias("intent_model_used"),
        ((F.col("event_id") % 100) / 100).alias("intent_confidence"),
        ((F.col("event_id") % 50) / 50).alias("retrieval_confidence"),
    )


def interaction_lookups(log: DataFrame) -> DataFrame:
    """A later request for each state: some too late, some with an unknown id."""
    e = F.col("event_id")
    return log.filter("endpoint = 'api_retrieve'").select(
        e.alias("lookup_id"),
        (e + F.when(e % 10 == 0, 1_000_000).otherwise(0)).cast("string").alias("interaction_id"),
        "tenant_id",
        (F.col("ts") + F.make_dt_interval(mins=(e % 240).cast("int"))).alias("requested_at"),
        F.concat(F.lit("Answer "), e.cast("string")).alias("generated_response"),
    )


STATES = """SELECT CAST(event_id AS VARCHAR) AS interaction_id, tenant_id,
    'call +91 98765 43210 or mail a.b@c.org about ' || ip AS purpose, 'ref AB-' || (event_id + 1000) AS key_points,
    ts AS created_at, ts + INTERVAL 2 HOUR AS expires_at, CASE WHEN event_id % 2 = 0 THEN 'customer_support' ELSE 'internal_ops' END AS workflow_type,
    'refund for a.b@c.org, request ' || event_id AS ops_query, CASE WHEN event_id % 3 <> 0 THEN 'refund' END AS intent, event_id % 3 <> 0 AS intent_model_used,
    CAST(event_id % 100 AS DOUBLE) / 100 AS intent_confidence, CAST(event_id % 50 AS DOUBLE) / 50 AS retrieval_confidence FROM request_log WHERE endpoint = 'api_retrieve'"""
LOOKUPS = """SELECT event_id AS lookup_id, CAST(event_id + CASE WHEN event_id % 10 = 0 THEN 1000000 ELSE 0 END AS VARCHAR)
    AS interaction_id, tenant_id, ts + to_minutes(event_id % 240) AS requested_at, 'Answer ' || event_id AS generated_response
    FROM request_log WHERE endpoint = 'api_retrieve'"""

CTES = {
    "kb_files": KB_FILES,
    "kb_manifest": KB_MANIFEST,
    "existing_files": EXISTING_FILES,
    "url_docs": URL_DOCS,
    "url_probe": URL_PROBE,
    "messages": MESSAGES,
    "emails": EMAILS,
    "model_outputs": MODEL_OUTPUTS,
    "corpus": CORPUS,
    "query_vectors": QUERY_VECTORS,
    "predictions": PREDICTIONS,
    "tickets": TICKETS,
    "request_log": REQUEST_LOG,
    "shifted_log": SHIFTED_LOG,
    "api_keys": API_KEYS,
    "states": STATES,
    "lookups": LOOKUPS,
    "chunks": Q.chunks("documents", "text", "doc_id", "doc_id"),
}


def sql(body: str, recursive: bool = False, **extra: str) -> str:
    return Q.with_ctes(body, {**CTES, **extra}, recursive)
