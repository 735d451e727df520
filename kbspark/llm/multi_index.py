"""Near-duplicates of embeddings by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved
from kbspark.llm.components import components

COSINE = 0.95
#: Vectors that the codebooks are fitted on, at most; hash order picks them.
SAMPLE = 20_000
#: Vectors in a cell of the grid, about, and centroids of a half, at most.
CELL, CENTROIDS = 12, 1024
#: Share of pairs right at the threshold that the traversal is to reach from one side.
RECALL = 0.9995
#: Cells of a grid row that are kept together, as a share of the row.
ROW_PARTS = 4
#: Stored and asking vectors that one task compares at once.
STORED, ASKING = 512, 4096


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * points @ centres.T + (centres * centres).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Codebook:
    """Independent centroids for the two halves of a unit vector; their product is the grid."""

    def __init__(self, centres: tuple[np.ndarray, np.ndarray], reach: float):
        self.centres, self.reach = centres, reach
        self.split = centres[0].shape[1]
        self.k = len(centres[0])
        self.apart = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-300)) for c in centres]

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 5) -> Codebook:
        """``reach`` is set so that of partners drawn right at the threshold, in
        random directions from the sample, the share ``recall`` lies in visited cells."""
        rng = np.random.default_rng(seed)
        half = sample.shape[1] // 2
        k = max(1, min(k, len(sample)))
        book = cls((_k_means(sample[:, :half], k, rng), _k_means(sample[:, half:], k, rng)), 0.0)
        from_ = sample[rng.integers(0, len(sample), 20_000)]
        noise = rng.standard_normal(from_.shape)
        noise -= (noise * from_).sum(1, keepdims=True) * from_
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        other = cosine * from_ + np.sqrt(1 - cosine * cosine) * noise
        far = []
        for i in range(0, len(from_), 2000):
            walls, cells = book.walls(from_[i:i + 2000]), book.cells(other[i:i + 2000])
            at = np.arange(len(cells[0]))
            far.append(walls[0][at, cells[0]] + walls[1][at, cells[1]])
        book.reach = min(float(np.quantile(np.concatenate(far), recall)), 2 - 2 * cosine)
        return book

    def __reduce__(self):
        return Codebook, (self.centres, self.reach)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, :self.split], unit[:, self.split:]

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((-2 * h @ c.T + (c * c).sum(1)).argmin(1) for h, c in zip(self.halves(unit), self.centres))

    def walls(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared distance from each vector to the wall
        between its own cell and each other one; nothing of that cell is nearer."""
        out = []
        for h, c, apart in zip(self.halves(unit), self.centres, self.apart):
            d = -2 * h @ c.T + (c * c).sum(1)
            own = d.argmin(1)
            at = np.arange(len(h))
            wall = (d - d[at, own][:, None]) / (2 * apart[own])
            wall[at, own] = 0.0
            out.append(wall * wall)
        return out

    def visits(self, walls: list[np.ndarray], row: int) -> Iterator[tuple[int, np.ndarray]]:
        """Multi-sequence traversal: cells in the order of the sum of both
        distances, until it is above the reach; (first code, second codes)."""
        order = np.argsort(walls[1][row], kind="stable")
        second = walls[1][row][order]
        for i in np.argsort(walls[0][row], kind="stable"):
            left = self.reach - walls[0][row][i]
            if left < 0:
                return
            yield int(i), order[:np.searchsorted(second, left, side="right")]


def _unit(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _routes(books: dict[int, Codebook]):
    def one_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for whole in batches:
            lengths = whole.column("n").to_numpy()
            for n in np.unique(lengths):
                of = whole.take(pa.array(np.flatnonzero(lengths == n)))
                for start in range(0, of.num_rows, 1000):
                    yield int(n), of.slice(start, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in one_length(batches):
            book = books[n]
            width = -(-book.k // ROW_PARTS)
            unit = _unit(batch.column("vector"))
            first, second = book.cells(unit)
            walls = book.walls(unit)
            at, i, part, asks = [], [], [], []
            for r in range(len(unit)):
                at.append(r)
                i.append(int(first[r]))
                part.append(int(second[r]) // width)
                asks.append(False)
                for a, js in book.visits(walls, r):
                    for p in np.unique(js // width):
                        at.append(r)
                        i.append(a)
                        part.append(int(p))
                        asks.append(True)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [rows.column("n"), pa.array(i, pa.int32()), pa.array(part, pa.int32()), pa.array(asks), rows.column("rep"),
                 rows.column("copies"), rows.column("vector")],
                names=["n", "i", "part", "asks", "rep", "copies", "vector"])

    return run


def _compare(books: dict[int, Codebook], cosine: float):
    def run(table: pa.Table) -> pa.Table:
        book = books[table.column("n")[0].as_py()]
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        rep = table.column("rep").to_numpy().astype(np.int64)
        copies = table.column("copies").to_numpy().astype(np.int64)
        empty = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        if asks.all() or not asks.any():
            return empty
        unit = _unit(table.column("vector").combine_chunks())
        s, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        ids, place = np.unique(rep, return_inverse=True)
        label = np.arange(len(ids))
        total = np.zeros(len(ids), np.int64)
        cells_s = np.column_stack(book.cells(unit[s]))
        for start in range(0, len(q), 1024):
            block = q[start:start + 1024]
            x, y = np.nonzero(unit[block] @ unit[s].T >= cosine)
            keep = rep[block[x]] != rep[s[y]]
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            asking = book.walls(unit[block])
            seen = asking[0][x, cells_s[y, 0]] + asking[1][x, cells_s[y, 1]] <= book.reach
            x, y = x[seen], y[seen]
            own = np.column_stack(book.cells(unit[block]))
            hit = np.unique(y)
            back = book.walls(unit[s[hit]])
            z = np.searchsorted(hit, y)
            mutual = back[0][z, own[x, 0]] + back[1][z, own[x, 1]] <= book.reach
            px, py = place[block[x]], place[s[y]]
            np.add.at(total, px, copies[s[y]])
            np.add.at(total, py[~mutual], copies[block[x[~mutual]]])
            while True:  # smallest label along the links of this block
                low = np.minimum(label[px], label[py])
                new = label.copy()
                np.minimum.at(new, px, low)
                np.minimum.at(new, py, low)
                np.minimum.at(new, label[px], low)
                np.minimum.at(new, label[py], low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        some = np.flatnonzero((total > 0) | (label != np.arange(len(ids))))
        return pa.table({"rep": ids[some], "links": total[some], "near": ids[label[some]]})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                    recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector.

    Equal vectors form a class that is compared once, by its smallest key. Each
    class is stored in one cell of the grid and asks the cells that the
    traversal visits; a pair counts if its cosine in double precision reaches
    ``cosine``. A pair that both sides visit is counted once, by a rule that both sides
    can work out; tasks return sums and a forest of links, never pairs.
    Full cells are cut into pieces, so no task holds a whole one.

    Vectors of different lengths link with nothing of each other; every length
    has a grid of its own. Vectors that are missing, empty, zero, or hold missing or
    non-finite components link with nothing. Rows without a key are left out,
    repeated keys count as one vector, their least one. An empty table gives no rows;
    other columns are ignored."""
    spark = vectors.sparkSession
    rows = (vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"),
                                                         F.col(vector).cast("array<double>").alias("vector"))
            .groupBy("id").agg(F.min("vector").alias("vector")))
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vector").isNotNull() & ~wrong & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("n", F.when(usable, F.size("vector")).otherwise(0))
    rows = rows.withColumn("class", F.when(F.col("n") > 0, F.struct("n", F.xxhash64("vector").alias("x"), F.hash("vector").alias("y"))))
    rows = saved(rows, "vectors")
    right = rows.where("n > 0")
    classes = right.groupBy("class").agg(F.first("n").alias("n"), F.min("id").alias("rep"), F.count("*").alias("copies"),
                                         F.first("vector").alias("vector"))
    classes = saved(classes, "vector-classes")
    books = {}
    for length, n in classes.groupBy("n").count().where("count > 1").orderBy("n").collect():  # a row for each length
        of = classes.where(F.col("n") == length)
        picked = of if n <= sample else of.where(
            F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
        fitted = np.array([r[0] for r in picked.orderBy(F.xxhash64("rep")).select("vector").limit(sample).collect()])
        fitted /= np.linalg.norm(fitted, axis=1, keepdims=True)
        books[length] = Codebook.fit(fitted, min(CENTROIDS, max(1, round((n / CELL) ** 0.5))), cosine, recall)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    several = classes.where(F.col("n").isin(list(books)))
    routed = several.select("n", "rep", "copies", "vector").repartition(parts, "rep").mapInArrow(
        _routes(books), "n int, i int, part int, asks boolean, rep long, copies long, vector array<double>")
    routed = saved(routed, "vector-routes")
    sizes = routed.groupBy("n", "i", "part").agg(  # at most ROW_PARTS * CENTROIDS rows for each length
        F.ceil(F.sum(F.when(F.col("asks"), 0).otherwise(1)) / STORED).cast("int").alias("ss"),
        F.ceil(F.sum(F.when(F.col("asks"), 1).otherwise(0)) / ASKING).cast("int").alias("qs")).where("ss > 0 and qs > 0")
    cut = routed.join(F.broadcast(sizes), ["n", "i", "part"])
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("qs")).otherwise(F.col("ss")))
    cut = cut.withColumn("mine", mine).withColumn(
        "others", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("ss")).otherwise(F.col("qs")) - 1)))
    cut = cut.select("n", "i", "part", F.when(F.col("asks"), F.col("others")).otherwise(F.col("mine")).cast("int").alias("s"),
                     F.when(F.col("asks"), F.col("mine")).otherwise(F.col("others")).cast("int").alias("q"),
                     "asks", "rep", "copies", "vector")
    found = saved(cut.groupBy("n", "i", "part", "s", "q").applyInArrow(
        _compare(books, cosine), "rep long, links long, near long"), "vector-links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep <> near"), "rep", "near")
    member = (right.select("id", "class").join(classes.select("class", "rep", "copies"), "class")
              .select("id", "rep", "copies"))
    member = (member.join(sums, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
              .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    other = rows.where("n = 0").select("id", F.lit(0).cast("long").alias("n_links"),
                                                         F.col("id").alias("component_id"))
    return member.unionByName(other).select(F.col("id").alias(key), "n_links", "component_id",
                                            (F.col("id") == F.col("component_id")).alias("kept"))
