"""Whitening against plain integers and numpy's eigenvectors, and on awkward rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from basinflow.llm import whitening
from basinflow.llm.whitening import components, exact_gram, identity_error, one_sided_jacobi, pivoted_cholesky, whiten


def integers(rows):
    return np.array([[math.floor(1024 * float(v)) + 100_000 for v in r] for r in rows], object)


def reference(x):
    """Covariance of integer rows in exact fractions, its eigenvalues and vectors."""
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in d.T @ d])
    values, vectors = np.linalg.eigh(cov)
    return n, s, d, values[::-1], vectors[:, ::-1], np.trace(cov)


def check(spark, rows, most=8, extra=()):
    df = spark.createDataFrame([(i, [*map(float, r)]) for i, r in enumerate(rows)] + [*extra], "vec_id long, embedding array<double>").repartition(3)
    made = whiten(df, most)
    found = {r.vec_id: r for r in made.collect()}
    x = integers(rows)
    n, s, d, values, vectors, trace = reference(x)
    assert sorted(found) == list(range(len(rows)))
    k = len(found[0].whitened)
    assert {r.n for r in found.values()} == {n}
    assert [int(found[i].deviation) for i in range(n)] == [sum(int(v) ** 2 for v in r) for r in d]
    assert found[0].explained == pytest.approx((values[:k] / trace).tolist(), rel=1e-9)
    w = np.array([found[i].whitened for i in range(n)])
    true = (d / n).astype(float) @ vectors[:, :k] / np.sqrt(values[:k])
    for j in range(k):
        sign = np.sign(w[:, j] @ true[:, j])
        assert np.allclose(w[:, j], sign * true[:, j], atol=1e-7)
    assert identity_error(made) < 1e-9
    return k


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 12)) * np.array([1, 0.9, 0.8, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.01])
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1e300] * 12), (906, [1.0, 2.0])]
    assert check(spark, rows, extra=odd) == 8


def test_rank_below_eight(spark):
    rng = np.random.default_rng(2)
    rows = np.round(rng.normal(size=(50, 2)) * 16) @ np.array([[1, 0, 1, 0, 2], [0, 1, 1, 0, 1]])
    assert check(spark, rows) == 2
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    assert whiten(one).count() == 0 and whiten(one.limit(1)).count() == 0 and whiten(one.limit(0)).count() == 0
    assert identity_error(whiten(one)) is None


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    assert check(spark, rng.normal(size=(40, 3)) * 1e9) == 3
    y = (rng.normal(size=(20, 3)) * 1e12).astype(np.int64)
    assert (exact_gram(y) == y.astype(object).T @ y.astype(object)).all()
    small = (rng.normal(size=(5000, 3)) * 3e6).astype(np.int64)
    assert (exact_gram(small) == small.astype(object).T @ small.astype(object)).all()


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    b = rng.normal(size=(9, 6)) * np.logspace(0, -5, 6)
    a = b @ b.T
    factor, order = pivoted_cholesky(a)
    assert factor.shape == (9, 6) and np.allclose(np.triu(factor[:6], 1), 0)
    assert np.allclose((factor @ factor.T), a[np.ix_(order, order)], atol=1e-12)
    values, columns = one_sided_jacobi(factor)
    assert np.allclose(columns.T @ columns, np.eye(6), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:6], rtol=1e-8, atol=1e-14)


def test_partitioning_changes_nothing(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i % 7, r) for i, r in enumerate(rng.normal(size=(200, 6)).tolist())], "vec_id long, embedding array<double>")
    one, other = (sorted(map(tuple, whiten(x).collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert np.allclose([r[3] for r in one], [r[3] for r in other], atol=1e-12) and [r[:3] for r in one] == [r[:3] for r in other]


def test_clashing_columns_and_query(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], i, "b", [1.0], 1) for i in range(30)], "vec_id int, embedding array<float>, n int, x string, whitened array<double>, k int")
    assert whiten(df).columns == ["vec_id", "n", "deviation", "whitened", "explained"] and whiten(df).count() == 30
    rows = whitening.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = integers([r.embedding for r in given])
    n, _, d, values, _, trace = reference(x)
    found = rows.collect()
    assert len(found) == 8 * n and {r.component for r in found} == set(range(1, 9)) and found[0].identity_error < 1e-9
    deviation = {r.vec_id: int((v * v).sum()) for r, v in zip(given, d)}
    assert all(r.deviation == deviation[r.vec_id] for r in found)
    assert all(r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9) for r in found)
    assert components(np.zeros((2, 2), object), 3)[0].size == 0
