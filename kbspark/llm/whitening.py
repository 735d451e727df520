"""Whitening of embeddings by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved

#: A component becomes floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Vectors of the subspace beside those asked for; they keep the wanted ones apart from the rest.
BESIDE = 28
#: Degree of the polynomial that damps the unwanted part of the spectrum between two Rayleigh-Ritz steps.
DEGREE = 12
#: A component is certified when |V q - e q| is at most this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: What rounding may leave of a residual that no longer falls, and rounds after which it has to have fallen.
FLOOR, ROUNDS = 1e-10, 200


def usable(vector: Column) -> Column:
    """Not missing, and without missing or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def in_steps(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each component, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def lists(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _rows(matrix: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(matrix), pa.int64()), pa.array(list(matrix.values()), pa.list_(pa.float64()))],
                                      names=["i", "row"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows of one number, as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in filter(len, batches):
        for i, row in zip(batch.column(0).to_pylist(), lists(batch.column(1), len(batch.column(1)[0]))):
            total[i] = total[i] + row if i in total else row
    if total:
        yield _rows(total)


class Covariance:
    """Products with the covariance of a table of distinct vectors, one pass over it each."""

    def __init__(self, fit: DataFrame, sums: list[int], n: int):
        self.fit, self.n, self.length = fit, n, len(sums)
        self.mean = np.array([s / n for s in sums])

    def _pass(self, part_sums) -> np.ndarray:
        """The sum over all tasks of a matrix that each task gathers from its vectors, centred."""
        mean, length = self.mean, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = part_sums(lists(batch.column(0), length).astype(np.float64) - mean)
                total = part if total is None else total + part
            if total is not None:
                yield _rows(dict(enumerate(total)))

        rows = self.fit.select("x").mapInArrow(run, "i long, row array<double>")
        rows = rows.repartition("i").mapInArrow(_added, "i long, row array<double>").collect()
        return np.array([r["row"] for r in sorted(rows)]) / self.n  # a row for each row of the matrix

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self._pass(lambda x: x.T @ (x @ q))

    def trace(self) -> float:
        return float(self._pass(lambda x: (x * x).sum(0)[:, None]).sum())

    def after(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the vectors projected by ``w``."""
        return self._pass(lambda x: (x @ w).T @ (x @ w))


def damped(v: Covariance, q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """A Chebyshev polynomial of V times ``q``: at most one in size on eigenvalues from 0 to ``cut``, steeply larger above it.

    The three-term recurrence is scaled by its value at ``top``, so that nothing overflows."""
    half = cut / 2
    ratio = first = half / (top - half)
    before, now = q, (vq - half * q) * (ratio / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        before, now = now, (v.times(now) - half * now) * (2 * following / half) - ratio * following * before
        ratio = following
    return now


def leading(v: Covariance, wanted: int = COMPONENTS, beside: int = BESIDE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the leading components, certified by their residuals."""
    size = min(v.length, wanted + beside)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.length, size)))[0]
    vq, left = v.times(q), []
    for _ in range(ROUNDS):
        e, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)  # Rayleigh-Ritz
        e, turn = e[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        if e[0] <= 0:
            return e[:0], q[:, :0]
        left.append(np.linalg.norm(vq - q * e, axis=0)[:wanted].max() / e[0])
        stuck = len(left) > 3 and left[-1] > left[-4] / 2
        if left[-1] <= RESIDUAL or stuck and left[-1] <= FLOOR:
            some = e[:wanted] > e[0] * 1e-12 * v.length  # the rest is rounding of a zero variance
            return e[:wanted][some], q[:, :wanted][:, some]
        q = np.linalg.qr(damped(v, q, vq, max(e[-1], e[0] * 1e-3), e[0]))[0]
        vq = v.times(q)
    raise ArithmeticError(f"no convergence: residuals {left[-3:]}")


def _whitened(rows: DataFrame, length: int, key: str, components: int) -> DataFrame | None:
    fit = saved(rows.select("x").distinct(), "fit-vectors")
    sums = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    n, total = sums[0]["n"], [r["s"] for r in sums]  # a row for each dimension
    v = Covariance(fit, total, n)
    e, q = leading(v, min(components, length))
    if not len(e):
        return None
    w = q / np.sqrt(e)
    error = float(np.abs(v.after(w) - np.eye(len(e))).max())
    share = (e / v.trace()).tolist()
    mean, width = v.mean, len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = (lists(batch.column(1), length) - mean) @ w
            ends = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                                             names=["id", "x", "deviation", "white"])

    apart = F.transform("x", lambda c, i: F.lit(n).cast("long") * c - F.get(F.array(*[F.lit(s).cast("long") for s in total]), i))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: a + d * d)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "x", deviation.alias("deviation")).mapInArrow(
        run, f"id {kind}, x array<bigint>, deviation long, white array<double>")
    out = out.select("id", "deviation", F.posexplode("white").alias("i", "whitened"))
    return out.select(F.col("id").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(F.array(*map(F.lit, share)), F.col("i")).alias("explained"),
                      F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and leading component.

    The components are fitted on each distinct vector once, so copies weigh nothing. Every product with the
    covariance is a pass over the fitted table: tasks centre their vectors, multiply and add up, and a matrix of
    length by subspace leaves each of them; the covariance itself is never formed. A Chebyshev polynomial damps the spectrum below the
    subspace, then QR and Rayleigh-Ritz, until the residuals certify each component.

    Left out are vectors that are missing, empty, or hold missing or non-finite components. Rows without a key and
    repeated rows stay, each with its own rows. Vectors of different lengths are fitted apart, each length with its own n. Directions without variance
    are no components: equal vectors alone, or an empty table, give no rows. Where components tie, any basis of theirs is returned. Deviations are exact; one beyond
    a long is an error, as is a component of 2**53 / scale or more. Other columns are ignored."""
    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0)).select(F.col(key).alias("id"), in_steps(F.col(vector), scale).alias("x"))
    rows = saved(rows, "whole-vectors")
    found = rows.groupBy(F.size("x").alias("length")).agg(
        F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")).orderBy("length").collect()  # a row for each length
    if any(r["most"] >= 2**53 for r in found):
        raise ArithmeticError(f"a component times {scale} is 2**53 or more")
    parts = [_whitened(rows.where(F.size("x") == r["length"]), r["length"], key, components) for r in found]
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    return rows.limit(0).select(F.col("id").alias(key), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                                F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
