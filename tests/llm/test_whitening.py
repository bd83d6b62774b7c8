"""Whitening against numpy on the same vectors, and each exact part against plain arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lapsewatch.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, component string"


def leverrier(matrix):
    """Coefficients, constant first, by the trace recursion in fractions."""
    d = len(matrix)
    m, c = np.zeros((d, d), object), [Fraction(1)]
    for k in range(1, d + 1):
        m = matrix @ m + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(-Fraction((matrix @ m).trace()) / k)
    return [int(v) for v in reversed(c)]


def psd(seed, d, rank, size=50):
    a = np.random.default_rng(seed).integers(-size, size, (d, rank)).astype(object)
    return a @ a.T


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 1), (7, 7), (12, 5)])
def test_polynomial_is_exact(spark, d, rank):
    matrix = psd(d, d, rank)
    assert whitening.characteristic_polynomial(spark, matrix) == leverrier(matrix)


def test_pivots_that_vanish(spark):
    matrix = np.diag([3, 3, 5, 0, 7]).astype(object)
    matrix[0, 4] = matrix[4, 0] = 2
    assert whitening.characteristic_polynomial(spark, matrix) == leverrier(matrix)


def test_roots():
    def poly(roots):
        c = [1]
        for r in roots:
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        return c
    found = whitening.RealRoots(poly([9, 9, 9, 4, 1, 1, 0, 0])).largest(8)
    assert [(round(float(r), 30), m) for r, m in found] == [(9, 3), (4, 1), (1, 2)]
    # Two irrational roots 1.4e-6 apart, of a polynomial with integer coefficients.
    close = whitening.RealRoots([10 ** 12 * 2 - 1, -2 * 10 ** 12, 5 * 10 ** 11]).largest(2)
    assert [m for _, m in close] == [1, 1]
    for r, _ in close:
        assert abs(float(5 * 10 ** 11 * r * r - 2 * 10 ** 12 * r + 2 * 10 ** 12 - 1)) < 1e-40


def test_components_of_a_multiple_root():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((4, 4)))
    del q
    matrix = np.array([[2, 1, 1], [1, 2, 1], [1, 1, 2]], object)  # roots 4, 1, 1
    found = whitening.null_space(matrix, Fraction(1), 2)
    basis = np.array(found)
    assert np.allclose(basis @ basis.T, np.eye(2), atol=1e-15)
    assert np.allclose(matrix.astype(float) @ basis.T, basis.T, atol=1e-14)


def expected(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n = len(x)
    moved = n * x.astype(object) - x.astype(object).sum(axis=0)
    centred = moved.astype(float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, (moved * moved).sum(axis=1), centred, values[order], columns[:, order]


def check(rows, vectors, width):
    n, deviation, centred, values, columns = expected(vectors)
    positive = int((values > 1e-9 * values[0]).sum())
    k = min(32, positive)
    assert len(rows) == n * k
    white = np.zeros((n, k))
    for r in rows:
        white[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    plain = centred @ columns[:, :k] / np.sqrt(values[:k])
    signs = np.sign((white * plain).sum(axis=0))
    assert np.allclose(white, plain * signs, atol=1e-8)
    assert np.allclose(white.T @ white / n, np.eye(k), atol=1e-9)


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids = {r.vec_id: i for i, r in enumerate(rows)}
    assert ids == {i: i for i in range(len(rows))}
    check(whitening.whiten(df, "vec_id", "embedding").collect(), [r.embedding for r in rows], 64)


def test_low_rank_and_unusable_rows(spark):
    draw = np.random.default_rng(5)
    vectors = (draw.standard_normal((60, 3)) @ draw.integers(-3, 4, (3, 3))).astype(np.float32)
    vectors = np.c_[vectors, np.full(60, 2.5, np.float32), vectors[:, 0]]
    rows = [(i, v.tolist(), 5, "x") for i, v in enumerate(vectors)]
    bad = [None, [1.0, None, 1.0, 1.0, 1.0], [math.nan] * 5, [math.inf] * 5, [], [3e38] * 5]
    rows += [(1000 + i, v, 5, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = whitening.whiten(df, "vec_id", "embedding").collect()
    n = 60
    assert {r.vec_id for r in out} == set(range(n)) and {r.n for r in out} == {n}
    check(out, vectors.tolist(), 5)


def test_copies_widths_and_empty_tables(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, "x")] * 4, SCHEMA)
    assert whitening.whiten(same, "vec_id", "embedding").count() == 0
    assert whitening.whiten(same.limit(0), "vec_id", "embedding").count() == 0
    mixed = spark.createDataFrame(
        [(None, [1.0, 2.0], 0, "x"), (2, [2.0, 2.0], 0, "x"), (3, [1.0], 0, "x"), (4, [5.0], 0, "x")], SCHEMA)
    out = whitening.whiten(mixed, "vec_id", "embedding").collect()
    assert sorted((r.vec_id or 0, r.component, r.n, abs(round(r.whitened, 12))) for r in out) == [
        (0, 1, 2, 1.0), (2, 1, 2, 1.0), (3, 1, 2, 1.0), (4, 1, 2, 1.0)]


def test_wide_integers(spark):
    vectors = [[(-1.0) ** i * 1e15 + i, i * 1e10] for i in range(6)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    out = whitening.whiten(df, "vec_id", "embedding").collect()
    assert len(out) == 12 and all(r.deviation is None and r.identity_error < 1e-9 for r in out)
