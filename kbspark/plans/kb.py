"""Knowledge-base jobs: full build and ingestion with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kbspark import constants as K
from kbspark.functions import rules as R
from kbspark.functions import text as X
from kbspark.operators import chunking, dedupe, models
from kbspark.session import cut_lineage, passing, spread
from kbspark.sources import sinks

CHUNK_COLUMNS = ("source", "file_name", "chunk_index", "text")


def load_chunks(
    uploads: DataFrame, base: DataFrame, pages: DataFrame, listed: DataFrame | None = None, allowed_domains=None
) -> DataFrame:
    """Chunks of uploads, of the base files they do not replace, and of the
    pages that are ``listed`` (url; all when omitted) or linked from a file.

    Files are (source, file_name, content), pages (url, html). A page enters
    once, however many files link to it: later copies would be exact repeats."""
    own = chunking.chunk(chunking.override_files(uploads, base)).select(*CHUNK_COLUMNS)
    if listed is not None:
        links = own.select(F.explode(X.url_list(F.col("text"))).alias("url"))
        pages = pages.join(links.union(listed.select("url")).distinct(), "url", "left_semi")
    return own.unionByName(chunking.page_chunks(pages, allowed_domains).select(*CHUNK_COLUMNS))


def chunk_order():
    return [F.desc("priority"), F.col("file_name"), F.col("chunk_index")]


def dedupe_chunks(chunks: DataFrame, threshold: float = K.SEMANTIC_THRESHOLD, scope: str | None = None) -> DataFrame:
    """Exact repeats, contained texts, then near-duplicates removed, within each ``scope`` when a column is named."""
    ranked = chunks.withColumn("priority", chunking.source_priority(F.col("source")))
    return _dedupe_scopes(ranked, threshold, scope) if scope else _dedupe(ranked, threshold)


def _dedupe_scopes(ranked: DataFrame, threshold: float, scope: str) -> DataFrame:
    """The same within scopes: rows of a small one meet where they lie, so its steps share a shuffle; larger ones
    take the steps of a whole table."""
    with passing(ranked.sparkSession) as cut:
        unique = dedupe.drop_repeats(spread(ranked, scope), chunk_order(), scope=(scope,))
        place = F.row_number().over(Window.partitionBy(scope).orderBy(*chunk_order()))
        unique = cut(unique.withColumn("id", place.cast("bigint")), "unique")
        small, large = dedupe.split_scopes(unique, scope)
        whole = dedupe.drop_contained(spread(small, scope), scope=scope, grouped=True)
        kept = dedupe.drop_near_duplicates(whole, "id", F.col("priority"), threshold=threshold, scope=scope, grouped=True)
        kept = kept.drop("id", "priority")
        if large is not None:
            kept = kept.unionByName(_dedupe(large.drop("id"), threshold, scope))
        return cut_lineage(kept, "kept")


def _dedupe(ranked: DataFrame, threshold: float, scope: str | None = None) -> DataFrame:
    spark = ranked.sparkSession
    # Each stage goes when the next one is stored.
    with passing(spark) as cut:
        with passing(spark) as cut_first:
            # Sorting looks at its input twice, so the texts are prepared once and kept.
            unique = cut_first(dedupe.drop_repeats(ranked, chunk_order(), scope=(scope,) if scope else ()), "unique")
            numbered = dedupe.in_order(unique, chunk_order(), "id", cut)
        whole = cut_lineage(dedupe.drop_contained(numbered, scope=scope, stored=True), "whole")
    kept = dedupe.drop_near_duplicates(whole, "id", F.col("priority"), threshold=threshold, scope=scope, stored=True)
    return kept.drop("id", "priority")


def build(
    uploads: DataFrame, base: DataFrame, pages: DataFrame, listed: DataFrame | None = None, allowed_domains=None
) -> DataFrame:
    """Chunks of a knowledge base built from scratch."""
    return dedupe_chunks(load_chunks(uploads, base, pages, listed, allowed_domains))


def build_index(
    uploads: DataFrame, base: DataFrame, pages: DataFrame, path: str, listed: DataFrame | None = None, allowed_domains=None,
    dim: int = models.DIM, model=None, mode: str = "errorifexists",
) -> DataFrame:
    """A knowledge base built from scratch, embedded and stored as a version of
    the vector table at ``path``; the stored rows, read back by their manifest."""
    chunks = build(uploads, base, pages, listed, allowed_domains)
    sinks.write_vectors(models.embed_chunks(chunks, dim, model), path, mode)
    return sinks.read_vectors(chunks.sparkSession, path, dim)


def admit(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Files with ``safe_name``, ``stored_name``, ``clean_text``, ``reason``
    (null when accepted) and ``stored``, checks in order: conflict with a
    stored file, hash, name and size, content. A content is cleaned once the
    checks before it are passed; the files they refuse have no ``clean_text``.

    Files of one stored name enter in the order of their names, so the first
    accepted one is a stored file to those after it. Of accepted files of one
    name, only the last is ``stored``: it has overwritten the others."""
    safe = X.safe_file_name(F.col("file_name"))
    named = manifest.withColumn("safe_name", safe).withColumn(
        "stored_name", F.concat(X.file_stem(F.col("safe_name")), F.lit(".txt")))
    taken = existing.select(F.col("file_name").alias("stored_name")).distinct().withColumn("taken", F.lit(True))
    keeps = ~F.coalesce("overwrite", F.lit(False))
    barred = F.coalesce("taken", F.lit(False)) & keeps
    mismatch = (F.coalesce("client_hash", F.lit("")) != "") & (F.col("client_hash") != F.sha2("content", 256))
    refused = F.coalesce(F.when(mismatch, "hash_mismatch"), R.file_rejection(F.col("safe_name"), F.col("size_bytes")))
    checked = named.join(taken, "stored_name", "left").withColumn("fault", refused)
    read = F.col("fault").isNull() & ~barred
    checked = checked.withColumn("clean_text", F.when(read, X.kb_clean(F.col("content"))))
    fault = F.coalesce("fault", F.when(read, X.kb_reject_reason(F.col("content"), F.col("clean_text"))))
    # Nameless files never enter, so they need not share a group.
    group = Window.partitionBy("stored_name", F.when(F.col("safe_name") == "", F.xxhash64("content")))
    earlier = group.orderBy("file_name", "content").rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(F.desc("file_name"), F.desc("content")).rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col("fault").isNull() & ~barred
    conflict = keeps & (F.col("taken").isNotNull() | F.coalesce(F.max("fits").over(earlier), F.lit(False)))
    decided = checked.withColumn("fault", fault).withColumn("fits", fits).withColumn(
        "reason", F.when(conflict, "kb_file_already_exists").otherwise(F.col("fault")))
    accepted = F.col("reason").isNull()
    overwritten = F.coalesce(F.max(accepted).over(later), F.lit(False))
    return decided.withColumn("stored", accepted & ~overwritten).drop("taken", "fault", "fits")


def ingest(manifest: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted chunks, de-duplicated within their file, and rejected files."""
    verdicts = cut_lineage(admit(manifest, existing).select(
        "file_name", "safe_name", "stored_name", "reason", "stored", F.when(F.col("stored"), F.col("clean_text")).alias("content")), "admitted")
    accepted = verdicts.filter("stored").select(F.lit("UPLOADED_KB").alias("source"), F.col("stored_name").alias("file_name"), "content")
    chunks = dedupe_chunks(chunking.chunk(accepted), scope="file_name")
    return chunks, verdicts.filter("reason is not null").select("file_name", "safe_name", "reason")
