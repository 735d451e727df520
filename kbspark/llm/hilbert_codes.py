"""Codes of vectors by codebooks of their parts, fitted over Hilbert-sorted blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved
from kbspark.llm.whitening import in_steps, lists, usable

#: A component becomes floor(SCALE * c).
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Bits of each axis on the Hilbert curve.
BITS = 4
#: Parts of vectors in a block.
BLOCK = 512


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The places of grid cells (rows of numbers below 2**bits) on the Hilbert curve, as bytes in its order.

    From the highest bit down, the axes below an odd half are mirrored and those below an even half swapped with the
    first, as the curve turns there; a Gray code of the bits read across the axes is the place."""
    x = cells.T.astype(np.uint32).copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(axes):
            odd = (x[i] >> np.uint32(b)) & np.uint32(1) == 1
            swap = np.where(odd, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(odd, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> np.uint32(b)) & np.uint32(1) == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turned
    across = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]).reshape(bits * axes, -1)
    packed = np.packbits(across.T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def split_at(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin and the last ends; the first ones are longer by one where ``parts`` does not divide the length."""
    return [0, *np.cumsum([len(p) for p in np.array_split(np.arange(length), parts)]).tolist()]


def _places(low: np.ndarray, high: np.ndarray, cuts: list[int], dtype: str):
    """Each vector as parts with their places on the curve of that part position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lists(batch.column(1), len(low))
            cells = ((x - low) / (high - low + 1.0) * (1 << BITS)).astype(np.int64)
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a == b:  # a part of no length has nothing to compare
                    continue
                values = x[:, a:b].astype(dtype)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p), pa.int32()), pa.array(hilbert_keys(cells[:, a:b]), pa.binary()), batch.column(0),
                     pa.array([v.tobytes() for v in values], pa.binary())], names=["part", "place", "row", "values"])

    return run


def _blocks(cuts: list[int], dtype: str):
    """Neighbours on the curve as one flat block with its box and sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = sorted({0, len(part), *(np.flatnonzero(np.diff(part)) + 1).tolist()})
            out = []
            for a, b in zip(edges, edges[1:]):
                for start in range(a, b, BLOCK):
                    of = batch.slice(start, min(BLOCK, b - start))
                    flat, p = b"".join(of.column(2).to_pylist()), int(part[start])
                    x = np.frombuffer(flat, dtype).reshape(of.num_rows, cuts[p + 1] - cuts[p]).astype(np.int64)
                    out.append((p, of.column(1).to_numpy(), flat, x.min(0), x.max(0), x.sum(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int64())] * 3))],
                names=["part", "rows", "flat", "low", "high", "sums"])

    return run


class Codebook:
    """Entries of one part position, whole numbers, and the exact search for the nearest."""

    def __init__(self, entries: np.ndarray, most: int):
        self.entries = entries
        # Squared distances and their terms are exact in doubles below 2**53; beyond, integers are multiplied.
        self.dtype = np.float64 if 16 * most * most * max(entries.shape[1], 1) < 2**53 else np.int64
        self.cast = entries.astype(self.dtype)
        self.squares = (self.cast * self.cast).sum(1)

    def shortlist(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries that may be nearest to something in a box: no farther at best than another one is at worst."""
        under, over = low - self.entries, self.entries - high
        best, worst = np.maximum(np.maximum(under, over), 0), np.maximum(np.abs(under), np.abs(over))
        return np.flatnonzero((best * best).sum(1) <= (worst * worst).sum(1).min())

    def nearest(self, x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row among the ascending ``some``; the lower entry of equally near ones."""
        c = x.astype(self.dtype)
        d = self.squares[some] - 2 * (c @ self.cast[some].T)
        near = d.argmin(1)
        return some[near], ((c * c).sum(1) + d[np.arange(len(c)), near]).astype(np.int64)


def _block_rows(batch: pa.RecordBatch, books: list[Codebook], dtype: str):
    """(part, ids of the rows, their values, shortlist, sums) of each block of a batch."""
    for p, rows, flat, low, high, sums in zip(*(batch.column(i).to_pylist() if i in (0, 2) else batch.column(i) for i in range(6))):
        arrays = [c.values.to_numpy(zero_copy_only=False) for c in (rows, low, high, sums)]
        x = np.frombuffer(flat, dtype).reshape(len(arrays[0]), len(arrays[1]))
        yield p, arrays[0], x, books[p].shortlist(arrays[1], arrays[2]), arrays[3]


def _sums(books: list[Codebook], dtype: str):
    """Count and sums of the parts nearest to each entry, gathered over a task's blocks; a block with one entry in its
    shortlist gives its stored sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        totals = [np.zeros_like(b.entries) for b in books]
        for batch in batches:
            for p, rows, x, some, sums in _block_rows(batch, books, dtype):
                if len(some) == 1:
                    counts[p][some[0]] += len(rows)
                    totals[p][some[0]] += sums
                else:
                    near = books[p].nearest(x, some)[0]
                    counts[p] += np.bincount(near, minlength=len(counts[p]))
                    np.add.at(totals[p], near, x.astype(np.int64))
        for p, (count, total) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(count[used]),
                     pa.array(list(total[used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: list[Codebook], dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, rows, x, some, _ in _block_rows(batch, books, dtype):
                near, far = books[p].nearest(x, some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(np.full(len(rows), p), pa.int32()), pa.array(near, pa.int32()), pa.array(far)],
                    names=["row", "part", "entry", "far"])

    return run


def _coded(rows: DataFrame, length: int, scale: int) -> DataFrame:
    """(row, code, error, codebooks_sha256) of the vectors of one length."""
    cuts = split_at(length)
    spans = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.min("c"), F.max("c")).orderBy("i").collect()
    low, high = (np.array([r[k] for r in spans], np.int64) for k in (1, 2))  # a row for each dimension
    most = int(max(np.abs(low).max(), np.abs(high).max())) + 1
    if 16 * most * most * length >= 2**63:
        raise ArithmeticError(f"components times {scale} up to {most} have squared distances beyond 64 bits")
    dtype = "<i4" if most < 2**31 else "<i8"

    ids = rows.orderBy(F.col("id").asc_nulls_last()).select("id").limit(ENTRIES).collect()
    first = rows if ids[-1][0] is None else rows.where(F.col("id") <= F.lit(ids[-1][0]))
    first = first.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()
    start = np.array([r[0] for r in first], np.int64)
    books = [Codebook(start[:, a:b], most) for a, b in zip(cuts, cuts[1:])]

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.select("row", "x").mapInArrow(_places(low, high, cuts, dtype), "part int, place binary, row long, values binary")
    order = ["part", "place", "row"]  # copies share a place; their rows keep them apart
    blocks = saved(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("part", "row", "values").mapInArrow(
        _blocks(cuts, dtype), "part int, rows array<bigint>, flat binary, low array<bigint>, high array<bigint>, sums array<bigint>"),
        "part-blocks")
    widest = max(b - a for a, b in zip(cuts, cuts[1:]))
    for _ in range(ROUNDS):
        sums = blocks.mapInArrow(_sums(books, dtype), "part int, entry int, n long, sums array<bigint>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(widest)])
        entries = [b.entries.copy() for b in books]
        for r in sums.collect():  # a row for each entry of each part
            width = entries[r["part"]].shape[1]
            entries[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
        books = [Codebook(e, most) for e in entries]
    digest = hashlib.sha256(",".join(str(v) for e in books for v in e.entries.ravel().tolist()).encode()).hexdigest()

    codes = blocks.mapInArrow(_codes(books, dtype), "row long, part int, entry int, far long")
    digits = [F.lpad(F.lower(F.hex(F.coalesce(F.max(F.when(F.col("part") == p, F.col("entry"))), F.lit(0)).cast("long"))), 2, "0") for p in range(PARTS)]
    return codes.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("far").alias("error")).withColumn(
        "codebooks_sha256", F.lit(digest))


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable vector.

    The parts of all vectors are range-sorted by their place on a Hilbert curve and kept in flat blocks with box and
    sums. In each round box distances leave a shortlist of entries per block; a block whose shortlist is one entry gives its sums, others
    compare their values with the shortlist in whole numbers. Blocks are read where they are stored; counts and
    sums of entries leave the tasks, and the codebooks, of fixed size, are all the driver holds.

    Left out are vectors that are missing or hold missing or non-finite components. Rows without a key come last in the order that
    starts the codebooks, rows of one key in that of their vectors; every repeated row is coded. Vectors of different lengths
    have codebooks of their own; where the parts do not divide a length the first ones are longer by one, and parts of
    no length are coded 00 without error. Rows without a label share one sum. An empty table gives no rows, other columns are ignored. Components
    so large that a squared distance leaves 64 bits are an error."""
    rows = vectors.where(usable(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(label).alias("label"),
        in_steps(F.col(vector), scale).alias("x"))
    rows = saved(rows, "whole-vectors")
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().orderBy(F.size("x")).collect()]  # a row for each length
    coded = rows.where(F.size("x") == 0).select("row", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"),
                                                F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    for length in lengths:
        if length:
            coded = coded.unionByName(_coded(rows.where(F.size("x") == length), length, scale))
    coded = saved(rows.select("row", "id", "label").join(coded, "row"), "vector-codes")
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    finite = "len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    out = [f"""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND {finite}),
parts AS (
  SELECT vec_id, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS v
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, v AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for i in range(ROUNDS + 1):
        out.append(f"""near{i} AS (
  SELECT vec_id, p, any_value(v) AS v,
         min((list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT * {ENTRIES} + entry) AS best
  FROM parts JOIN book{i} USING (p) GROUP BY vec_id, p)""")
        if i < ROUNDS:
            out.append(f"""book{i + 1} AS (
  WITH sums AS (
    SELECT p, entry, pos, floor(sum(value) / count(*)) AS mean
    FROM (SELECT p, best % {ENTRIES} AS entry, unnest(v) AS value, unnest(range(len(v))) AS pos FROM near{i})
    GROUP BY p, entry, pos),
  means AS (SELECT p, entry, list(mean ORDER BY pos) AS c FROM sums GROUP BY p, entry)
  SELECT p, entry, coalesce(means.c, old.c) AS c FROM book{i} AS old LEFT JOIN means USING (p, entry))""")
    return "WITH " + ",\n".join(out) + f""",
codes AS (
  SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error
  FROM near{ROUNDS} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY p, entry, pos)) AS codebooks_sha256
  FROM (SELECT p, entry, unnest(c) AS value, unnest(range(len(c))) AS pos FROM book{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest"""


SQL = _sql()
