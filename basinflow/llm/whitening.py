"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Components are turned into integers, so sums and products over all rows can be exact: tasks subtract the rounded mean and multiply
blocks so small that a double holds every sum of products, the blocks' sums are added as whole numbers, and the rounding of the mean
is taken out of the total, again in whole numbers. The scatter matrix is thus the same for any partitioning. Only it goes to the
driver: its size is the square of the dimension, whatever the number of rows.

The scatter is factored as L times its transpose with the largest remaining diagonal entry as pivot, up to its numerical rank.
Rotations of pairs of L's columns make them orthogonal; their squared norms are the eigenvalues and the normalised columns, rows
put back in order, the components. Small eigenvalues keep their relative accuracy that way.

Defined cases: vectors that are null, empty or hold null or non-finite entries, or entries whose integer is over 2 ** 53, take no
part; of the others those of the commonest length do, of two equally common lengths the longer; repeated rows and vec_ids are rows of
their own and a null vec_id goes through; there are as many components as the rank has, so that equal vectors, a single one or an
empty table give no rows; a deviation that a long cannot hold is null in the query. Columns other than vec_id and embedding are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from basinflow.llm.common import discard, materialize, table
from basinflow.session import ship

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Sums of products up to here are exact in a double; sums of squares in a long.
EXACT, LONG = 2.0**53, 2.0**62
SWEEPS, EPSILON = 60, 2.0**-52


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) with x as long integers, of the vectors that take part."""
    c = F.col("embedding")
    scaled = F.transform(c, lambda v: F.floor(SCALE * v.cast("double")))
    fit = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(SCALE * v.cast("double")) < EXACT))
    rows = embeddings.where(c.isNotNull() & (F.size(c) > 0) & F.coalesce(fit, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda v: v.cast("long") + SHIFT).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    commonest = sizes.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    return rows.where(F.size("x") == F.lit(commonest or 0))


def block(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The vectors of a batch as a matrix."""
    column = batch.column(name)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """The sum of outer products of the rows as Python integers. In doubles where blocks of some rows stay exact."""
    most = float(np.abs(y).max(initial=0)) ** 2
    total = np.zeros((y.shape[1],) * 2, object)
    if most >= EXACT:
        y = y.astype(object)
        return y.T @ y
    rows = int(min(max(EXACT // max(most, 1), 1), max(len(y), 1)))
    for k in range(0, len(y), rows):
        part = y[k : k + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def exact_squares(d: np.ndarray) -> list[int]:
    """The sum of squares of each row as Python integers."""
    if float(np.abs(d.astype(np.float64)).max(initial=0)) ** 2 * d.shape[1] < LONG:
        d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def exact_sum(y: np.ndarray) -> np.ndarray:
    """The sum of the rows as Python integers."""
    fits = float(np.abs(y).max(initial=0)) * len(y) < LONG
    return (y.sum(axis=0) if fits else y.astype(object).sum(axis=0)).astype(object)


def total(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], column: str = "x") -> list:
    """The sum, over all blocks of vectors, of what a function gives for a block, as many numbers for each: Python integers of long
    vectors, doubles of double ones. Every task sends its own sum, and Spark adds them; the result is of the function's size."""
    ship(vectors.sparkSession)
    exact = vectors.schema[column].dataType.elementType == LongType()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                more = of(block(batch, column))
                found = more if found is None else found + more
        if found is not None:
            values = pa.array([Decimal(int(v)) for v in found], pa.decimal128(38, 0)) if exact else pa.array(found, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), values], ["k", "v"])

    parts = vectors.select(column).mapInArrow(partial, f"k int, v {'decimal(38,0)' if exact else 'double'}")
    rows = sorted(parts.groupBy("k").agg(F.sum("v").alias("v")).collect())
    return [int(r.v) if exact else r.v for r in rows]


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""
    found = total(vectors, lambda x: np.append(exact_sum(x), len(x)))
    return (found[-1], found[:-1]) if found else (0, [])


def scatter(vectors: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """n times the centred scatter, in Python integers."""
    size, mean = len(s), np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    upper = np.triu_indices(size)
    gram = np.zeros((size, size), object)
    gram[upper] = total(vectors, lambda x: exact_gram(x - mean)[upper])
    gram = gram + np.triu(gram, 1).T
    left = np.array([v - n * int(m) for v, m in zip(s, mean)], object)
    return n * gram - np.outer(left, left)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L', L lower triangular with as many columns as the numerical rank."""
    a, size = a.copy(), len(a)
    order, factor = np.arange(size), np.zeros((size, size))
    least = size * EPSILON * a.diagonal().max(initial=0)
    for k in range(size):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, a.T, factor):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared column norms, normalised columns) of factor times a rotation that makes its columns orthogonal, largest first."""
    c = np.array(factor, order="F")
    for _ in range(SWEEPS):
        turned = False
        for p in range(c.shape[1] - 1):
            for q in range(p + 1, c.shape[1]):
                a, b, g = c[:, p] @ c[:, p], c[:, q] @ c[:, q], c[:, p] @ c[:, q]
                if abs(g) <= 8 * EPSILON * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * g)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                x, y = c[:, p].copy(), c[:, q].copy()
                c[:, p], c[:, q] = cos * (x - t * y), cos * (t * x + y)
        if not turned:
            break
    norms = np.linalg.norm(c, axis=0)
    falling = np.argsort(-norms, kind="stable")
    return norms[falling] ** 2, c[:, falling] / norms[falling]


def components(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance, and its trace; gram is n times the scatter."""
    scale = max(1, max((int(v) for v in gram.diagonal()), default=1))
    # Whole numbers are divided before they become doubles: each entry is rounded once.
    near = np.array([[int(v) / scale for v in row] for row in gram])
    factor, order = pivoted_cholesky(near)
    values, columns = one_sided_jacobi(factor)
    vectors = np.empty_like(columns)
    vectors[order] = columns
    unit = scale / (n * n)
    return values * unit, vectors, sum(int(v) for v in gram.diagonal()) / (n * n)


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row for each vector that takes part: vec_id, n, deviation (decimal: the sum of squares of n * x - S), whitened and explained
    (arrays over the components)."""
    spark = embeddings.sparkSession
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"
    vectors = materialize(integer_vectors(embeddings))
    n, s = sums(vectors)
    values, axes, trace = components(scatter(vectors, n, s), n) if n else (np.empty(0), np.empty((0, 0)), 0.0)
    values, axes = values[:most], axes[:, :most]
    if not len(values):
        return spark.createDataFrame([], schema)
    share, by_root, whole = (values / trace).tolist(), axes / np.sqrt(values), np.array(s, object)
    small = max(map(abs, s)) < LONG / 4

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch, "x")
            near = float(np.abs(x).max(initial=0)) * n < LONG / 4
            d = n * x - whole.astype(np.int64) if small and near else n * x.astype(object) - whole
            squares = [Decimal(v) if v < 10**38 else None for v in exact_squares(d)]
            centred = (d / n).astype(np.float64)
            made = centred @ by_root
            columns = [
                batch.column("vec_id"), pa.array([n] * len(x), pa.int64()), pa.array(squares, pa.decimal128(38, 0)),
                pa.array(made.tolist(), pa.list_(pa.float64())), pa.array([share] * len(x), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened", "explained"])

    made = materialize(vectors.mapInArrow(project, schema))
    discard(vectors)
    return made


def identity_error(whitened: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors, over all of them, minus the identity; they are centred by
    their own means first."""
    found = total(whitened, lambda w: np.append(w.sum(axis=0), len(w)), "whitened")
    if not found:
        return None
    n, mean = found[-1], np.array(found[:-1]) / found[-1]
    covariance = np.array(total(whitened, lambda w: ((w - mean).T @ (w - mean)).ravel(), "whitened")) / n
    return float(np.abs(covariance - np.eye(len(mean)).ravel()).max())


def op13_embedding_whitening(spark, sf_dir):
    made = whiten(table(spark, sf_dir, "embeddings"))
    error = F.lit(identity_error(made)).cast("double").alias("identity_error")
    each = made.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "w"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "w.whitened", "w.explained", error)
