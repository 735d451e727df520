"""Line de-duplication, whitening and vector codes: brute force, and nulls, long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import hilbert_codes, line_dedup, whitening

DOCS = "doc_id long, text string"


def key_by_hand(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def lines_by_hand(rows, documents=10, shortest=1):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key_by_hand(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [s for s in lines if len(k := key_by_hand(s)) < shortest or len(held[k]) < documents]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def line_rows():
    r = random.Random(3)
    pool = ["Home", " home\t", "HOME\r", "É", "é", "", "  ", "\x0b\x0cx", "a  b", "a b", "ends ", "<|x|>", "中文"]
    rows = [(i, "\n".join(r.choice(pool + [f"own {i} {k}" for k in range(6)]) for _ in range(r.randrange(0, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "\n\nHome\n"), (64, "home"), (None, "Home\nleft"), (None, "only"), (None, None)]
    rows += [(65, "rep\nhome"), (65, "rep\nhome"), (65, "rep")] + [(70 + i, "nine") for i in range(9)] + [(79 + i, "ten ") for i in range(10)]
    rows += [(70, "nine again\nnine"), (99, "\n".join(f"line {i % 700}\nhome" for i in range(20_000)) + "z" * 300_000)]
    return rows


def test_common_lines_by_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("places", F.lit("clash")).withColumn("lines", F.lit(1)).withColumn("n_lines", F.lit("old"))
    got = line_dedup.drop_common_lines(docs)
    assert got.columns == [*docs.columns, "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == lines_by_hand(rows)
    assert {(r.places, r.lines) for r in got.collect()} == {("clash", 1)}
    few = line_dedup.drop_common_lines(docs, documents=3, shortest=4)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in few.collect()), key=str) == lines_by_hand(rows, 3, 4)


def test_common_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert line_dedup.drop_common_lines(docs).collect() == []


def odd_vectors(spark, x, extra=()):
    rows = [(i, v.tolist(), i % 3 if i % 5 else None) for i, v in enumerate(x)]
    length = x.shape[1]
    rows += [(1000, None, 1), (1001, [float("nan")] * length, 1), (1002, [float("inf")] + [0.0] * (length - 1), 2),
             (1003, [None] + [0.0] * (length - 1), None), *extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("clash")).withColumn(
        "x", F.lit("clash")).withColumn("id", F.lit(0))


def whitened_by_hand(vectors, components=4):
    x = np.floor(256 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, q = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    e, q = e[::-1], q[:, ::-1]
    white = (x - s / n) @ q[:, :components] / np.sqrt(e[:components])
    return n, ((n * x - s) ** 2).sum(1), white, e[:components] / e.sum()


@pytest.mark.parametrize("length", [3, 24])
def test_whitening_by_numpy(spark, length):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, length)) @ r.standard_normal((length, length)) / 4
    x[200:260] = x[7]  # copies weigh nothing
    own = [(7, x[7].tolist(), 1), (None, x[9].tolist(), None)]
    got = whitening.whiten(odd_vectors(spark, x, own)).collect()
    n, deviation, white, share = whitened_by_hand(x)
    k = white.shape[1]
    assert len(got) == (300 + 2) * k and {g.n for g in got} == {n} and n <= 241
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for g in sorted(got, key=lambda g: g.vec_id is None):
        i, c = 9 if g.vec_id is None else g.vec_id, g.component - 1
        assert g.deviation == deviation[i] and g.explained == pytest.approx(share[c], rel=1e-10)
        sign.setdefault(c, 1 if abs(g.whitened - white[i, c]) < 1e-6 else -1)
        assert sign[c] * g.whitened == pytest.approx(white[i, c], abs=1e-8)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    alike = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)
    assert whitening.whiten(alike).collect() == []
    flat = spark.createDataFrame([(i, [i / 10, 0.5, 0.5]) for i in range(20)], schema)  # one direction varies
    assert {(g.component, g.n) for g in whitening.whiten(flat).collect()} == {(1, 20)}
    lengths = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(30)] + [(40 + i, [float(i)]) for i in range(4)] + [(50, [])], schema)
    got = whitening.whiten(lengths).collect()
    assert sorted({(g.n, g.component) for g in got}) == [(4, 1), (30, 1), (30, 2)] and len(got) == 64
    with pytest.raises(ArithmeticError):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], schema))


def test_chebyshev_filter_on_a_close_spectrum(spark):
    """Eigenvalues less than one per cent apart are told apart, in a bounded number of passes."""
    r = np.random.default_rng(4)
    spectrum = np.concatenate([[1.03, 1.02, 1.01, 1.0], np.linspace(0.95, 0.1, 56)])
    q = np.linalg.qr(r.standard_normal((60, 60)))[0]
    v = (q * spectrum) @ q.T

    class Local:
        length, passes = 60, 0

        def times(self, y):
            self.passes += 1
            return v @ y

    local = Local()
    e, found = whitening.leading(local)
    assert e == pytest.approx(spectrum[:4], rel=1e-12) and np.abs(np.abs(found.T @ q[:, :4]) - np.eye(4)).max() < 1e-9
    assert local.passes < 120


def codes_by_hand(rows, entries=256, parts=4, rounds=4):
    """rows: (id, vector, label) kept ones."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], list(rows[i][1])))
    x = np.floor(1024 * np.array([v for _, v, _ in rows], np.float32).astype(float)).astype(np.int64)
    cuts = np.cumsum([0] + [len(p) for p in np.array_split(np.arange(x.shape[1]), parts)])
    near, far, books = [], np.zeros(len(x), np.int64), []
    for a, b in zip(cuts, cuts[1:]):
        p = x[:, a:b]
        book = p[order[:entries]].copy()
        for turn in range(rounds + 1):
            d = ((p[:, None, :] - book[None]) ** 2).sum(2)
            to = d.argmin(1)
            if turn < rounds:
                for k in set(to.tolist()):
                    book[k] = p[to == k].sum(0) // (to == k).sum()
        near.append(to)
        far += d.min(1)
        books.append(book)
    sums = {}
    for (_, _, label), e in zip(rows, far.tolist()):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(i, "".join(f"{n[k]:02x}" for n in near), int(far[k]), sums[label], digest) for k, (i, _, label) in enumerate(rows)]


@pytest.mark.parametrize("n, length", [(700, 16), (40, 10), (1500, 3)])
def test_codes_by_brute_force(spark, n, length):
    r = np.random.default_rng(n)
    x = (r.standard_normal((12, length))[r.integers(0, 12, n)] + 0.03 * r.standard_normal((n, length))) / 2
    x[n // 2:n // 2 + n // 3] = x[1]  # copies of one vector are a third of all
    own = [(None, x[5].tolist(), 2), (3, x[3].tolist(), 0)]
    vectors = odd_vectors(spark, x.astype(np.float32), own)
    kept = [(i, v.tolist(), i % 3 if i % 5 else None) for i, v in enumerate(x)] + own
    got = [tuple(g) for g in hilbert_codes.codes(vectors.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(codes_by_hand(kept), key=str)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert hilbert_codes.codes(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [], "a"), (2, [0.5], "a"), (3, [0.25], None), (4, [1.0, 2.0, 3.0, 4.0], "a"), (5, [30_000.0, 0.0, 0.0, -30_000.0], None)]
    got = {g.vec_id: (g.code, g.error, g.label_error) for g in hilbert_codes.codes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("00000000", 0, 0), 3: ("01000000", 0, 0), 4: ("00000000", 0, 0), 5: ("01010101", 0, 0)}
    with pytest.raises(ArithmeticError):
        hilbert_codes.codes(spark.createDataFrame([(1, [1e8], None)], schema))


@pytest.mark.parametrize("axes, bits", [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_to_neighbours(axes, bits):
    """Along the curve every step changes one axis by one, and every cell is visited once."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert_codes.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_leave_short_lists_on_clustered_parts():
    """Blocks of one cluster are settled by their boxes, and a shortlist never loses the nearest entry."""
    r = np.random.default_rng(8)
    book = hilbert_codes.Codebook(r.integers(-1000, 1000, (256, 8)), 1000)
    settled = 0
    for k in range(200):
        x = book.entries[k] + r.integers(-40, 40, (50, 8))
        some = book.shortlist(x.min(0), x.max(0))
        settled += len(some) == 1
        whole, part = book.nearest(x, np.arange(256)), book.nearest(x, some)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    assert settled > 150
    tied = hilbert_codes.Codebook(np.array([[5], [1], [1], [9]]), 10)
    assert tied.nearest(np.array([[1], [3], [7]]), np.arange(4))[0].tolist() == [1, 0, 0]
    large = hilbert_codes.Codebook(np.array([[2**29], [2**29 - 1]]), 2**29)
    assert large.dtype == np.int64 and large.nearest(np.array([[2**29 - 1]]), np.arange(2))[1].tolist() == [0]
