"""Knowledge-base queries: scans, joins, de-duplication, builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import fixtures as X
from kbspark.catalog import sqlkit as Q
from kbspark.catalog import usage_queries as U
from kbspark.catalog.fixtures import sql, table
from kbspark.operators import chunking, dedupe
from kbspark.session import cut_lineage, work_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def plain_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.chunk(docs)


def with_id(chunks):
    """Chunk id that sorts as (doc_id, chunk_index)."""
    return chunks.withColumn("id", F.col("doc_id") * 1_000_000 + F.col("chunk_index"))


UNIQUE = """SELECT doc_id, chunk_index, text, doc_id * 1000000 + chunk_index AS id FROM chunks
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, chunk_index) = 1"""
CONTAINED = """SELECT DISTINCT a.id FROM uniq a JOIN uniq b ON length(a.text) < length(b.text) AND contains(b.text, a.text)"""


@query("dedupe_exact", sql("SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM uniq", uniq=UNIQUE))
def dedupe_exact(spark, sf_dir):
    return dedupe.drop_repeats(plain_chunks(spark, sf_dir), [F.col("doc_id"), F.col("chunk_index")])


@query("dedupe_substring", sql("""SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM uniq
    WHERE id NOT IN (SELECT id FROM contained)""", uniq=UNIQUE, contained=CONTAINED))
def dedupe_substring(spark, sf_dir):
    unique = cut_lineage(with_id(dedupe_exact(spark, sf_dir)), "unique")   # read twice
    return dedupe.drop_contained(unique, stored=True).drop("id")


def doc_priority():
    return chunking.source_priority(X.pick(F.col("doc_id") % 4, "UPLOADED_KB", "URL", "KB", "KB"))


def contest_ctes(rows: str, vectors: str) -> dict[str, str]:
    """CTEs of the sequential contest over ``rows`` (id, strength) and
    ``vectors`` (id, term, n): one step per edge, in order."""
    return {
        "rows_in": rows,
        "vecs": vectors,
        "len2": "SELECT id, sum(n * n) AS l FROM vecs GROUP BY id",
        "dots": "SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS d FROM vecs x JOIN vecs y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2",
        "edges": """SELECT a, b, ra.strength >= rb.strength AS a_wins, row_number() OVER (ORDER BY a, b) AS step
            FROM dots JOIN len2 la ON la.id = a JOIN len2 lb ON lb.id = b JOIN rows_in ra ON ra.id = a JOIN rows_in rb ON rb.id = b
            WHERE d > 0.96::DOUBLE * sqrt(la.l * lb.l)""",
        "contest": """SELECT 0::BIGINT AS step, CAST([] AS BIGINT[]) AS gone UNION ALL
            SELECT e.step, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone
                WHEN a_wins THEN list_append(gone, b) ELSE list_append(gone, a) END
            FROM contest c JOIN edges e ON e.step = c.step + 1""",
        "losers": "SELECT unnest(gone) AS id FROM (SELECT gone FROM contest ORDER BY step DESC LIMIT 1)",
    }


DOC_VECTORS = "SELECT id, term, count(*)::DOUBLE AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+')) AS term FROM documents) GROUP BY 1, 2"
DOC_ROWS = f"SELECT doc_id AS id, {X.sql_pick('doc_id % 4', '3', '0', '1', '1')} * 1000000000::BIGINT + length(text) AS strength FROM documents"


@query("dedupe_semantic", sql("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM losers)",
                              recursive=True, **contest_ctes(DOC_ROWS, DOC_VECTORS)))
def dedupe_semantic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe.drop_near_duplicates(docs, "doc_id", doc_priority(), stored=True).select("doc_id")   # the given table is not stored again


# -- scans ----------------------------------------------------------------

@query("scan_kb_text", sql("""SELECT 'KB' AS source, 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.TXT' END AS file_name,
    trim(text, chr(32)||chr(9)||chr(10)||chr(13)) || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END AS content FROM documents
    WHERE doc_id % 4 <> 2"""))
def scan_kb_text(spark, sf_dir):
    from kbspark.sources import readers

    d = F.col("doc_id")
    kind = X.pick(d % 4, ".txt", ".TXT", ".pdf", ".TXT")
    stored = F.concat(F.trim("text").cast("binary"), F.when(d % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/kb/doc"), d.cast("string"), kind).alias("path"), stored.alias("content"))
    return readers.text_files(files, "KB")


@query("scan_url_list", sql("SELECT DISTINCT url FROM pages"))
def scan_url_list(spark, sf_dir):
    from kbspark.session import work_dir
    from kbspark.sources import readers

    path = work_dir(spark, "urls")
    pages = table(spark, sf_dir, "pages")
    pages.select(F.to_json(F.struct(F.array("url", "url").alias("urls")))).write.text(path)
    return readers.scan_url_list(spark, path, multi_line=False)


@query("distinct_urls", sql("SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT url FROM url_probe)"))
def distinct_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").union(X.url_probe(spark, sf_dir).select("url")).distinct()


def html_sql(expr: str) -> str:
    from kbspark.functions import text as T

    c = Q.replace_all(expr, [(T.MARKUP, "\x01")])
    for _ in range(2):  # matches overlap by one mark
        c = Q.replace_all(c, [("\x01[ \t\r\f]*\n[ \t\r\n\f]*\x01", "\x01\n\x01"), ("\x01[ \t\r\f]+\x01", "\x01 \x01")])
    c = Q.replace_all(c, [("\x01+", "\n"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&")])
    return Q.strip(c)


PAGE_TEXTS = f"""SELECT url, 'URL' AS source, replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_') AS file_name,
    {html_sql('html')} AS content FROM pages"""
PAGES = {
    "page_texts": PAGE_TEXTS,
    "page_parts": Q.chunks("page_texts", "content", "url, source, file_name", "url"),
}


@query("scan_pages_to_chunks", sql("SELECT source, file_name, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM page_parts", **PAGES))
def scan_pages_to_chunks(spark, sf_dir):
    return chunking.page_chunks(table(spark, sf_dir, "pages")).select("source", "file_name", "chunk_index", "text")


@query("scan_policy_json", sql("""SELECT doc_id, 'Refund Window: ' || n_chars || '\nLang List:\n- ' || lang || '\n- all\nSource Name: ' || source
    || '\nIs Public: ' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'None' END AS content FROM documents"""))
def scan_policy_json(spark, sf_dir):
    from kbspark.functions import text as T

    return X.policy_json(spark, sf_dir).select("doc_id", T.policy_text(F.col("policy")).alias("content"))


@query("scan_labelled_csv", sql("SELECT replace(text, chr(10), ' ') AS text, lang AS label FROM documents"))
def scan_labelled_csv(spark, sf_dir):
    from kbspark.session import work_dir
    from kbspark.sources import readers

    path = work_dir(spark, "labelled")
    rows = table(spark, sf_dir, "documents").select(F.translate("text", "\n", " ").alias("text"), F.col("lang").alias("label"))
    rows.write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return readers.scan_labelled_csv(spark, path)


# -- file level -----------------------------------------------------------

EFFECTIVE = """SELECT * FROM kb_files WHERE source = 'UPLOADED_KB' UNION ALL SELECT * FROM kb_files
    WHERE source = 'KB' AND file_name NOT IN (SELECT file_name FROM kb_files WHERE source = 'UPLOADED_KB')"""


def two_sources(spark, sf_dir):
    files = X.kb_files(spark, sf_dir)
    return files.filter("source = 'UPLOADED_KB'"), files.filter("source = 'KB'")


@query("kb_override", sql("SELECT source, file_name, content FROM effective", effective=EFFECTIVE))
def kb_override(spark, sf_dir):
    uploads, base = two_sources(spark, sf_dir)
    return chunking.override_files(uploads, base).select("source", "file_name", "content")


@query("existing_file_conflict", sql(f"""SELECT doc_id FROM (SELECT *, {Q.safe_file_name('file_name')} AS safe FROM kb_manifest)
    WHERE NOT overwrite AND regexp_replace(safe, '[.][^.]*$', '') || '.txt' IN (SELECT file_name FROM existing_files)"""))
def existing_file_conflict(spark, sf_dir):
    from kbspark.functions import text as T

    safe = T.safe_file_name(F.col("file_name"))
    named = X.kb_manifest(spark, sf_dir).filter(~F.col("overwrite")).withColumn("safe", safe)
    stored = named.select("doc_id", F.concat(T.file_stem(F.col("safe")), F.lit(".txt")).alias("file_name"))
    return stored.join(X.existing_files(spark, sf_dir), "file_name", "left_semi").select("doc_id")


LINKED = {
    **PAGES,
    "doc_parts": Q.chunks("url_docs", "content", "source, file_name", "file_name"),
    "first_links": r"""SELECT source, file_name, link, min(chunk_index) AS at_chunk FROM (SELECT source, file_name, chunk_index,
        unnest(list_distinct(regexp_extract_all(text, 'https?://[^\s]+'))) AS link FROM doc_parts) GROUP BY ALL""",
    "expanded": """SELECT file_name AS from_file_name, chunk_index AS at_chunk, '' AS link, source, file_name, chunk_index, text FROM doc_parts
        UNION ALL SELECT l.file_name, at_chunk, link, p.source, p.file_name, p.chunk_index, p.text FROM first_links l JOIN page_parts p ON p.url = l.link""",
}


@query("chunk_url_expand", sql("""SELECT from_file_name, CAST(at_chunk AS INTEGER) AS at_chunk, link, source, file_name,
    CAST(chunk_index AS INTEGER) AS chunk_index, text FROM expanded""", **LINKED))
def chunk_url_expand(spark, sf_dir):
    docs = chunking.chunk(X.url_docs(spark, sf_dir))
    pages = chunking.page_chunks(table(spark, sf_dir, "pages"))
    return chunking.expand_links(docs, pages).drop("from_source")


UNION = {
    **PAGES,
    "effective": EFFECTIVE,
    "own_parts": Q.chunks("effective", "content", "source, file_name", "source, file_name"),
    "all_parts": "SELECT source, file_name, chunk_index, text FROM own_parts UNION ALL SELECT source, file_name, chunk_index, text FROM page_parts",
}


@query("corpus_union", sql("SELECT source, file_name, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM all_parts", **UNION))
def corpus_union(spark, sf_dir):
    from kbspark.plans import kb

    uploads, base = two_sources(spark, sf_dir)
    cols = ["source", "file_name", "content"]
    return kb.load_chunks(uploads.select(*cols), base.select(*cols), table(spark, sf_dir, "pages"))


BUILD = {
    **UNION,
    "prioritised": "SELECT *, CASE source WHEN 'UPLOADED_KB' THEN 3 WHEN 'KB' THEN 1 ELSE 0 END AS priority FROM all_parts",
    "uniq": """SELECT *, row_number() OVER (ORDER BY priority DESC, file_name, chunk_index) AS id FROM prioritised
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY priority DESC, file_name, chunk_index) = 1""",
    "contained": CONTAINED,
    "whole": "SELECT * FROM uniq WHERE id NOT IN (SELECT id FROM contained)",
}


def chunk_contest() -> dict[str, str]:
    rows = "SELECT id, priority * 1000000000::BIGINT + length(text) AS strength FROM whole"
    vecs = "SELECT id, term, count(*)::DOUBLE AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+')) AS term FROM whole) GROUP BY 1, 2"
    return contest_ctes(rows, vecs)


@query("kb_build", sql("SELECT source, file_name, CAST(chunk_index AS INTEGER) AS chunk_index, text, 64 AS dim FROM whole WHERE id NOT IN (SELECT id FROM losers)",
                       recursive=True, **BUILD, **chunk_contest()))
def kb_build(spark, sf_dir):
    from kbspark.plans import kb

    uploads, base = two_sources(spark, sf_dir)
    cols = ["source", "file_name", "content"]
    rows = kb.build_index(uploads.select(*cols), base.select(*cols), table(spark, sf_dir, "pages"), work_dir(spark, "index"), dim=64)
    return rows.select("source", "file_name", "chunk_index", "text", F.size("embedding").alias("dim"))


INGEST = {
    "named": f"""SELECT *, {Q.safe_file_name('file_name')} AS safe_name, {Q.kb_clean('content')} AS clean_text FROM kb_manifest""",
    "verdict": """SELECT *, regexp_replace(safe_name, '[.][^.]*$', '') || '.txt' AS stored_name, CASE
        WHEN NOT overwrite AND regexp_replace(safe_name, '[.][^.]*$', '') || '.txt' IN (SELECT file_name FROM existing_files) THEN 'kb_file_already_exists'
        WHEN client_hash <> sha256(content) THEN 'hash_mismatch' WHEN safe_name = '' THEN 'MISSING_FILE_NAME'
        WHEN regexp_extract(safe_name, '[.][^.]*$') NOT IN ('.txt', '.pdf', '.json') THEN 'UNSUPPORTED_FILE_TYPE'
        WHEN size_bytes > 5242880 THEN 'FILE_TOO_LARGE' WHEN content = '' THEN 'empty' WHEN length(clean_text) < 100 THEN 'too_short'
        WHEN NOT regexp_matches(clean_text, '[a-zA-Z0-9]{3,}') THEN 'no_tokens' END AS reason FROM named""",
    "accepted": "SELECT doc_id, stored_name, clean_text FROM verdict WHERE reason IS NULL",
    "in_parts": Q.chunks("accepted", "clean_text", "doc_id, stored_name", "doc_id"),
    "uniq": """SELECT *, doc_id * 1000000 + chunk_index AS id, 3 AS priority FROM in_parts
        QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY chunk_index) = 1""",
    "contained": "SELECT DISTINCT a.id FROM uniq a JOIN uniq b ON a.doc_id = b.doc_id AND length(a.text) < length(b.text) AND contains(b.text, a.text)",
    "whole": "SELECT * FROM uniq WHERE id NOT IN (SELECT id FROM contained)",
}


def file_contest() -> dict[str, str]:
    ctes = chunk_contest()
    ctes["dots"] = ctes["dots"].replace("AND x.id < y.id", "AND x.id < y.id AND x.id // 1000000 = y.id // 1000000")
    return ctes


@query("kb_ingest_with_rejects", sql("""SELECT file_name, reason, 0::BIGINT AS n_chunks FROM verdict WHERE reason IS NOT NULL UNION ALL
    SELECT stored_name, 'accepted', count(*) FROM whole WHERE id NOT IN (SELECT id FROM losers) GROUP BY stored_name""",
                                     recursive=True, **INGEST, **file_contest()))
def kb_ingest_with_rejects(spark, sf_dir):
    from kbspark.plans import kb

    chunks, rejects = kb.ingest(X.kb_manifest(spark, sf_dir), X.existing_files(spark, sf_dir))
    kept = chunks.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_chunks"))
    return rejects.select("file_name", "reason", F.lit(0).cast("bigint").alias("n_chunks")).unionByName(
        kept.select("file_name", F.lit("accepted").alias("reason"), "n_chunks"))


# -- sinks read back ------------------------------------------------------

@query("sink_vector_table", sql("""SELECT chunk_id, source, file_name, text, len(embedding) AS dim, CAST(list_sum(list_transform(
    embedding, lambda e, i: i * CAST(floor(CAST(e AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS digest FROM corpus"""))
def sink_vector_table(spark, sf_dir):
    from kbspark.session import work_dir
    from kbspark.sources import sinks

    path = work_dir(spark, "vectors")
    sinks.write_vectors(X.corpus(spark, sf_dir), path)
    return sinks.read_vectors(spark, path, 64).select(
        "chunk_id", "source", "file_name", "text", F.size("embedding").cast("bigint").alias("dim"),
        F.aggregate(F.transform("embedding", lambda e, i: (i + 1) * F.floor(e.cast("double") * 1000000)),
                    F.lit(0).cast("bigint"), lambda total, x: total + x).alias("digest"))


@query("sink_jsonl_logs", sql("""SELECT tenant_id, CAST(event_id AS VARCHAR) AS request_id, endpoint, us, 'success' AS status FROM request_log"""))
def sink_jsonl_logs(spark, sf_dir):
    from kbspark.session import work_dir
    from kbspark.sources import readers, sinks

    path = work_dir(spark, "logs")
    log = X.request_log(spark, sf_dir).select(
        "tenant_id", F.col("event_id").cast("string").alias("request_id"), "endpoint", F.col("ts").alias("created_at"),
        F.lit("success").alias("status"))
    sinks.write_logs(log, path)
    return readers.scan_logs(spark, path, "api_requests").select(
        "tenant_id", "request_id", "endpoint", F.unix_micros("created_at").alias("us"), "status")


@query("scan_jsonl_logs", sql("""SELECT endpoint, count(*) AS n FROM request_log GROUP BY endpoint"""))
def scan_jsonl_logs(spark, sf_dir):
    return sink_jsonl_logs(spark, sf_dir).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


@query("sink_usage_upsert", sql("""SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) AS total_requests,
    count(*) FILTER (WHERE is_llm) AS llm_calls, count(*) FILTER (WHERE is_llm) * 5 AS estimated_ai_cost FROM shifted_log GROUP BY ALL"""))
def sink_usage_upsert(spark, sf_dir):
    from kbspark.sources import sinks

    return sinks.read_usage(spark, stored_usage(spark, sf_dir), fan=2)


def stored_usage(spark, sf_dir) -> str:
    """The log's counters in five batches, the last of which arrives twice; entries are summed by twos."""
    from kbspark.operators import usage
    from kbspark.session import work_dir
    from kbspark.sources import sinks

    path = work_dir(spark, "usage")
    log = X.shift_days(X.request_log(spark, sf_dir), 15)
    for batch in (0, 1, 2, 3, 4, 4):
        sinks.add_usage(usage.usage_increments(log.filter(F.pmod(F.dayofmonth("ts"), F.lit(5)) == batch)), path, batch, fan=2)
    return path


@query("sink_usage_daily", U.ORACLES["usage_daily"])
def sink_usage_daily(spark, sf_dir):
    from kbspark.sources import sinks

    days = sinks.read_daily_usage(spark, stored_usage(spark, sf_dir), fan=2)
    return U.day_text(days, "usage_date")


@query("sink_usage_peak_day", U.ORACLES["usage_peak_day"])
def sink_usage_peak_day(spark, sf_dir):
    from kbspark.operators import usage
    from kbspark.sources import sinks

    peaks = usage.peak_day(sinks.read_daily_usage(spark, stored_usage(spark, sf_dir), fan=2))
    return U.day_text(peaks, "peak_day")
