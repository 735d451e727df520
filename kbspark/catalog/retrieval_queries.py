"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import fixtures as X
from kbspark.catalog.fixtures import sql
from kbspark.operators import retrieval as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def six(c):
    return F.round(c, 6)


# Squared distance: list_distance is its root.
RETRIEVAL = {
    "near": """SELECT query_id, source, chunk_id, pow(list_distance(vector, embedding), 2) AS distance
        FROM query_vectors, corpus QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY distance, chunk_id)
        <= CASE source WHEN 'KB' THEN 5 ELSE 3 END""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance / (distance + 1.0),
        CASE source WHEN 'KB' THEN 0 ELSE 1 END, chunk_id) AS rank, distance / (distance + 1.0) AS score
        FROM near QUALIFY rank <= 6""",
    "described": """SELECT r.query_id, r.rank, r.score, r.chunk_id, '[SOURCE:' || c.source || '] [FILE:' || c.file_name
        || '] [CHUNK:' || c.chunk_index || ']' AS header, c.text FROM ranked r JOIN corpus c USING (chunk_id)""",
    "listed": """SELECT query_id, list(score ORDER BY score) AS s, string_agg(header || '\n' || text, '\n---\n' ORDER BY rank)
        AS context_text, string_agg(header, ';' ORDER BY rank) AS sources, first(header ORDER BY rank) AS top_source
        FROM described GROUP BY query_id""",
    "bundles": """SELECT query_id, context_text, sources, top_source, s[1] AS best_distance,
        greatest(0.0, least(1.0, 0.5 * (1 - s[1] / 0.8::DOUBLE) + 0.3 * coalesce((s[2] - s[1]) / 0.8::DOUBLE, 0)
        + 0.2 * coalesce((list_sum(s[2:]) / (len(s) - 1) - s[1]) / 0.8::DOUBLE, 0))) AS confidence FROM listed""",
}


def rsql(body: str, **extra: str) -> str:
    return sql(body, **RETRIEVAL, **extra)


@query("knn_topk", rsql("""SELECT query_id, chunk_id, round(distance, 6) AS distance FROM
    (SELECT query_id, chunk_id, pow(list_distance(vector, embedding), 2) AS distance FROM query_vectors, corpus)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 5"""))
def knn_topk(spark, sf_dir):
    corpus = X.corpus(spark, sf_dir).select("chunk_id", F.lit("all").alias("source"), "embedding")
    hits = R.nearest(X.query_vectors(spark, sf_dir), corpus, {"all": 5})
    return hits.select("query_id", "chunk_id", six("distance").alias("distance"))


@query("topk_per_source", rsql("SELECT query_id, source, chunk_id, round(distance, 6) AS distance FROM near"))
def topk_per_source(spark, sf_dir):
    hits = R.nearest(X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir))
    return hits.select("query_id", "source", "chunk_id", six("distance").alias("distance"))


@query("merge_rerank", rsql("SELECT query_id, CAST(rank AS INTEGER) AS rank, source, chunk_id, round(score, 6) AS score FROM ranked"))
def merge_rerank(spark, sf_dir):
    hits = R.nearest(X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir))
    return R.merge_ranked(hits).select("query_id", "rank", "source", "chunk_id", six("score").alias("score"))


@query("score_normalize", sql("""SELECT vec_id, round(d, 6) AS distance, round(d / (d + 1.0), 6) AS score FROM
    (SELECT vec_id, pow(list_distance(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 2) AS d FROM embeddings)"""))
def score_normalize(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    d = F.aggregate(F.zip_with(e, F.reverse(e), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    out = X.table(spark, sf_dir, "embeddings").select("vec_id", d.alias("d"))
    return out.select("vec_id", six("d").alias("distance"), six(R.normalised(F.col("d"))).alias("score"))


@query("retrieval_confidence", rsql("SELECT query_id, round(confidence, 6) AS confidence, round(best_distance, 6) AS best_distance FROM bundles"))
def retrieval_confidence(spark, sf_dir):
    ranked = R.merge_ranked(R.nearest(X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir)))
    scores = ranked.groupBy("query_id").agg(F.collect_list("score").alias("scores"))
    return scores.select(
        "query_id", six(R.confidence(F.col("scores"))).alias("confidence"),
        six(F.array_min("scores")).alias("best_distance"))


@query("context_concat", rsql("SELECT query_id, context_text, sources FROM bundles"))
def context_concat(spark, sf_dir):
    found = R.bundle(R.retrieve(X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir)))
    return found.select("query_id", "context_text", F.array_join("sources", ";").alias("sources"))


@query("retrieve_batch", rsql("""SELECT query_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, header AS source,
    substring(text, 1, 200) AS chunk_preview, round(confidence, 6) AS confidence FROM described JOIN bundles USING (query_id)"""))
def retrieve_batch(spark, sf_dir):
    hits = R.retrieve(X.query_vectors(spark, sf_dir), X.corpus(spark, sf_dir))
    sure = R.bundle(hits).select("query_id", "confidence")
    return hits.join(sure, "query_id").select(
        "query_id", "rank", six("score").alias("score"), F.col("header").alias("source"), "chunk_preview",
        six("confidence").alias("confidence"))
