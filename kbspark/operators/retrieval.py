"""Exact batch top-k retrieval, scores, confidence and context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark import constants as K
from kbspark.functions import text as X
from kbspark.session import work_dir

CORPUS_BLOCK = 32_768       # rows of one corpus block, about
QUERY_BLOCK = 4096          # rows of one query block, about
READ_BUFFER = 1 << 20       # bytes read at once of a file of queries
CELLS = 1_000_000           # distances held at once by one worker
HIT_SCHEMA = "query_id bigint, source string, chunk_id bigint, distance double"


def _top_k(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest corpus rows of each query, ties to the smaller id.

    A matrix product finds who can be among them, with a margin for rounding;
    their distances are then summed term by term in double precision."""
    found = []
    c_norm = (c * c).sum(axis=1)
    step, near = max(1, CELLS // max(len(c), 1)), max(1, CELLS // max(c.shape[1], 1))
    for lo in range(0, len(q), step):
        part = q[lo:lo + step]
        rough = (part * part).sum(axis=1)[:, None] + c_norm[None, :] - 2.0 * (part @ c.T)
        if len(c) > k:
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
            margin = 1e-9 * (1.0 + np.abs(bound))
            qi, ci = np.nonzero(rough <= (bound + margin)[:, None])
        else:
            qi, ci = np.nonzero(np.ones_like(rough, dtype=bool))
        exact = np.empty(len(qi))
        for at in range(0, len(qi), near):   # equal vectors may make every cell a candidate
            gap = part[qi[at:at + near]] - c[ci[at:at + near]]
            exact[at:at + near] = (gap * gap).sum(axis=1)
        order = np.lexsort((c_ids[ci], exact, qi))
        qi, ci, exact = qi[order], ci[order], exact[order]
        first = np.searchsorted(qi, qi, side="left")
        keep = np.arange(len(qi)) - first < k
        found.append((q_ids[lo + qi[keep]], c_ids[ci[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _hits(q_ids, q, block: pd.DataFrame, budgets: dict[str, int]) -> pd.DataFrame:
    parts = []
    for source, k in budgets.items():
        own = block[block["source"] == source]
        if len(own) and len(q):
            c = np.stack(own["embedding"].to_numpy()).astype("float64")
            ids, chunks, dist = _top_k(q_ids, q, own["chunk_id"].to_numpy(), c, k)
            parts.append(pd.DataFrame({"query_id": ids, "source": source, "chunk_id": chunks, "distance": dist}))
    return pd.concat(parts) if parts else pd.DataFrame(
        {"query_id": pd.Series(dtype="int64"), "source": pd.Series(dtype="object"),
         "chunk_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})


def _blocks(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames joined until they have ``rows`` rows; empty ones are left out."""
    held, n = [], 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            n += len(frame)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def stored_batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of the parquet files of a folder, ``rows`` at a time. Files are read one after the other through a
    buffer, without reading ahead, so that a worker holds a batch and not row groups of several files."""
    system, path = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
    files = system.get_file_info(fs.FileSelector(path))
    for name in sorted(f.path for f in files if f.is_file and f.size and f.base_name[0] not in "_."):
        with system.open_input_file(name) as source:
            stored = pq.ParquetFile(source, buffer_size=READ_BUFFER, pre_buffer=False)
            yield from stored.iter_batches(batch_size=rows, use_threads=False)


def nearest(queries: DataFrame, corpus: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """Nearest chunks of each query and source: query_id, source, chunk_id,
    distance (squared L2). ``queries`` is (query_id, vector), ``corpus``
    (chunk_id, source, embedding); ``budgets`` is k per source.

    The corpus stays where it is, without a shuffle. The queries are written
    to the shared folder once; for each block of its rows a task reads them
    block by block, so it holds one block of either side, and a query gets at
    most k rows per source and corpus block. Rows without a vector are left out."""
    budgets = budgets or K.TOP_K_BUDGETS
    vectors = corpus.filter(F.col("source").isin(*budgets) & F.col("embedding").isNotNull()).select(
        "chunk_id", "source", "embedding")
    folder = work_dir(corpus.sparkSession, "queries")
    queries.filter(F.col("vector").isNotNull()).select("query_id", "vector").write.parquet(folder)
    c_rows, q_rows = CORPUS_BLOCK, QUERY_BLOCK

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, c_rows):
            for asked in _blocks((b.to_pandas() for b in stored_batches(folder, q_rows)), q_rows):
                vecs = np.stack(asked["vector"].to_numpy()).astype("float64")
                yield _hits(asked["query_id"].to_numpy(), vecs, block, budgets)

    return within_budget(vectors.mapInPandas(scan, HIT_SCHEMA), budgets)


def within_budget(hits: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """The nearest rows of each query and source, up to the source's budget."""
    allowed = F.lit(0)
    for source, k in budgets.items():
        allowed = F.when(F.col("source") == source, k).otherwise(allowed)
    nearest_first = Window.partitionBy("query_id", "source").orderBy("distance", "chunk_id")
    # The constant bound lets Spark cut every group before the shuffle.
    ranked = hits.withColumn("_rn", F.row_number().over(nearest_first)).filter(F.col("_rn") <= max(budgets.values()))
    return ranked.filter(F.col("_rn") <= allowed).drop("_rn")


def normalised(distance: Column) -> Column:
    """Squared distance mapped to [0, 1), order kept."""
    return distance / (distance + F.lit(1.0))


def merge_ranked(hits: DataFrame, top: int = K.FINAL_TOP_K, budgets: dict[str, int] | None = None) -> DataFrame:
    """Both candidate lists in one ranking; on a tie the source listed first wins."""
    place = F.lit(len(budgets or K.TOP_K_BUDGETS))
    for i, source in enumerate(budgets or K.TOP_K_BUDGETS):
        place = F.when(F.col("source") == source, i).otherwise(place)
    scored = hits.withColumn("score", normalised(F.col("distance")))
    best_first = Window.partitionBy("query_id").orderBy("score", place, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)


def confidence(scores: Column, scale: float = K.CONFIDENCE_SCALE, weights=K.CONFIDENCE_WEIGHTS) -> Column:
    """Confidence of a set of scores (array): how near the best is, and how far
    it stands out from the second and from the mean of the rest."""
    s = F.sort_array(scores)
    n = F.size(s)
    best = F.get(s, F.lit(0))
    rest = F.aggregate(F.slice(s, 2, F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda acc, x: acc + x)
    gap = F.when(n > 1, F.get(s, F.lit(1)) - best).otherwise(0.0)
    mean_rest = F.when(n > 1, rest / (n - 1)).otherwise(best)
    value = (
        weights[0] * (F.lit(1.0) - best / scale)
        + weights[1] * (gap / scale)
        + weights[2] * ((mean_rest - best) / scale)
    )
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))).otherwise(0.0)


def describe(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ranked hits with their header, preview and chunk text."""
    chunks = corpus.select("chunk_id", "file_name", "chunk_index", "text")
    header = X.chunk_header(F.col("source"), F.col("file_name"), F.col("chunk_index"))
    return ranked.join(chunks, "chunk_id").select(
        "query_id", "rank", "score", "chunk_id", header.alias("header"),
        X.preview(F.col("text")).alias("chunk_preview"), "text",
    )


def bundle(described: DataFrame) -> DataFrame:
    """One row per query: context, scores, confidence and sources, in rank order.
    A query has at most the final top-k rows, so its list is short."""
    hit = F.struct("rank", "score", "header", "text")
    lists = described.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    chunk = F.transform("hits", lambda h: F.concat_ws("\n", h["header"], h["text"]))
    return lists.select(
        "query_id",
        F.array_join(chunk, K.CONTEXT_SEPARATOR).alias("context_text"),
        F.col("hits.score").alias("scores"),
        confidence(F.col("hits.score")).alias("confidence"),
        F.array_min("hits.score").alias("best_distance"),
        F.col("hits.header").alias("sources"),
    )


def retrieve(
    queries: DataFrame, corpus: DataFrame, budgets: dict[str, int] | None = None, top: int = K.FINAL_TOP_K
) -> DataFrame:
    """Ranked, described hits of every query."""
    return describe(merge_ranked(nearest(queries, corpus, budgets), top, budgets), corpus)
