"""Whitened principal components of an embedding table.

1. Entries become whole numbers on a fixed grid. The fit list holds each distinct grid vector once (a grouped distinct with partial aggregation, so a vector
   that very many rows share is one row per task before the exchange) and is written to the shared folder.
2. Sums per dimension are gathered in whole numbers. The covariance is made of vectors that are centred first: every task multiplies its own batches and
   gives its partial sums, which a grouped sum adds up; the driver gets length * length / 2 numbers, whatever the number of rows or tasks.
3. The covariance is brought to tridiagonal form by Householder reflections, the leading eigenvalues are enclosed by bisection on Sturm counts, and inverse
   iteration finds their vectors, made orthogonal again within each cluster of close eigenvalues.
4. The components (at most ``count`` * length numbers) go to all tasks, which project every row. One more pass over the fit list measures how
   far the covariance of the whitened rows is from the identity.

Results for odd input: rows with a null or empty vector, or one with null or non-finite entries, are dropped, as are vectors of another length than the
commonest; repeated rows are all returned and fitted once; a null vec_id is kept; entries beyond 2**55 count as 2**55; a deviation that no
long can hold is null; a component without variance (fewer distinct vectors than dimensions) has ``explained`` 0 and ``whitened`` null and
takes no part in ``identity_error``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.components import stored
from trustlens.llm.vectors import finite_vectors, matrix

COUNT = 16
STEP, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 61)  # of a scaled entry
CLUSTER = 1e-3  # eigenvalues this close, by the norm of the matrix, are made orthogonal to each other
EPSILON = float(np.finfo(float).eps)
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with a = q t q'."""
    a, size = a.copy(), len(a)
    q = np.eye(size)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if not norm:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        p -= (v @ p) * v
        inner -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def counts_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each x: the negative pivots of t - x."""
    least = EPSILON * max(np.abs(off).max(initial=0), np.abs(diagonal).max(initial=0), 1e-300)
    pivot = diagonal[0] - x
    below = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = d - x - e * e / np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection from Gershgorin's bounds."""
    size = len(diagonal)
    edge = np.append(np.abs(off), 0) + np.insert(np.abs(off), 0, 0)
    low, high = np.full(count, (diagonal - edge).min()), np.full(count, (diagonal + edge).max())
    high += EPSILON * np.abs(high) + 1e-300
    wanted = size - 1 - np.arange(count)  # so many eigenvalues are smaller
    for _ in range(2000):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = counts_below(diagonal, off, middle) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Solve (t - value) y = right by elimination with row exchanges; a pivot of nothing counts as rounding error."""
    size = len(diagonal)
    least = EPSILON * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    main, first, second, y = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * size, right.tolist()
    for i in range(size - 1):
        under, next_main, next_first = float(off[i]), main[i + 1], first[i + 1]
        if abs(under) > abs(main[i]):
            main[i], first[i], second[i], next_main, next_first, under = under, next_main, next_first, first[i], second[i], main[i]
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(main[i]) < least:
            main[i] = least
        f = under / main[i]
        main[i + 1], first[i + 1] = next_main - f * first[i], next_first - f * second[i]
        y[i + 1] -= f * y[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(size - 1, -1, -1):
        rest = (first[i] * y[i + 1] if i + 1 < size else 0.0) + (second[i] * y[i + 2] if i + 2 < size else 0.0)
        y[i] = (y[i] - rest) / main[i]
        if abs(y[i]) > 1e150:  # only the direction counts
            y = [v * 1e-150 for v in y]
    return np.array(y)


def leading_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    size = len(covariance)
    count = min(count, size)
    norm = np.abs(covariance).max()
    if not norm:
        return np.zeros(count), np.eye(size)[:, :count]
    scaled = covariance / norm
    diagonal, off, q = tridiagonal(scaled)
    values = leading_eigenvalues(diagonal, off, count)
    width, shift, rng = np.abs(values).max(), np.inf, np.random.default_rng(size)
    vectors = np.zeros((size, count))
    for j, value in enumerate(values):
        shift = min(value, shift - 10 * EPSILON * width)  # equal eigenvalues are told apart
        near = vectors[:, :j][:, values[:j] - value <= CLUSTER * width]
        y = rng.standard_normal(size)
        for _ in range(6):
            y = solve_shifted(diagonal, off, shift, y / np.linalg.norm(y))
            for _ in range(2):
                y /= np.linalg.norm(y)
                y -= near @ (near.T @ y)
        vectors[:, j] = y / np.linalg.norm(y)
    vectors = q @ vectors
    found = np.einsum("ij,ij->j", vectors, scaled @ vectors)
    order = np.argsort(-found, kind="stable")
    return found[order] * norm, vectors[:, order]


def gathered(parts: DataFrame, size: int) -> np.ndarray:
    """Grouped sums of (i, j, v) as a matrix."""
    out = np.zeros((size, size))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def products(fit: DataFrame, length: int, middle: np.ndarray, rest: np.ndarray, project: np.ndarray | None = None) -> DataFrame:
    """i, j, v: per task the products of all pairs of dimensions (of the projected ones, if a projection is given), summed over its centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = length if project is None else project.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            centred = (matrix(batch.column(0), length) - middle) - rest
            centred = centred if project is None else centred @ project
            total += centred.T @ centred
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return fit.mapInArrow(run, "i int, j int, v double")


def dimension_sums(fit: DataFrame, length: int) -> tuple[int, list[int], int, int]:
    """Number of vectors, exact sum of each dimension, least and largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, least, most = 0, np.zeros(length, np.int64), np.zeros(length, np.int64), None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), length)
                n += len(x)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            columns = [np.arange(length), np.full(length, n), low, high, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["i", "n", "low", "high", "least", "most"])

    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high")]
    parts = fit.mapInArrow(run, "i bigint, n bigint, low bigint, high bigint, least bigint, most bigint")
    found = sorted(parts.groupBy("i").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most")).collect())
    if not found:
        return 0, [], 0, 0
    return int(found[0]["n"]), [int(r["low"]) + (int(r["high"]) << 32) for r in found], min(r["least"] for r in found), max(r["most"] for r in found)


def whiten(embeddings: DataFrame, count: int = COUNT, step: float = STEP, shift: int = SHIFT, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error of every usable row."""
    spark = embeddings.sparkSession
    usable, length = finite_vectors(embeddings, ids, column)
    scaled = lambda c: F.greatest(F.least(c.cast("double") * F.lit(step), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = usable.select("vec_id", F.transform("vector", lambda c: F.floor(scaled(c)) + F.lit(shift).cast("bigint")).alias("x"))
    if not length:
        return spark.createDataFrame([], RESULT)
    fit = stored(rows.select("x").distinct(), "fit")
    n, sums, least, most = dimension_sums(fit, length)
    whole = [s // n for s in sums]
    middle, rest = np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    covariance = gathered(products(fit, length, middle, rest), length) / n
    values, vectors = leading_components(covariance, count)
    trace = float(np.trace(covariance))
    live = values > length * EPSILON * trace
    project = vectors / np.sqrt(np.where(live, values, 1))
    own = gathered(products(fit, length, middle, rest, project[:, live]), int(live.sum())) / n if live.any() else np.zeros((0, 0))
    error = float(np.abs(own - np.eye(len(own))).max(initial=0))
    explained = np.where(live, values / trace if trace else 0.0, 0.0)
    remainders = [s - w * n for s, w in zip(sums, whole, strict=True)]
    bound = max(most - min(whole), max(whole) - least) * n + n
    narrow = length * bound * bound < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(live)
        for batch in batches:
            x = matrix(batch.column(1), length)
            if narrow:
                deviations = pa.array(((((x - middle) * n - np.array(remainders)) ** 2).sum(axis=1)), pa.int64())
            else:
                exact = [sum(((v - w) * n - r) ** 2 for v, w, r in zip(row, whole, remainders, strict=True)) for row in x.tolist()]
                deviations = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            whitened = (((x - middle) - rest) @ project).ravel()
            by_row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(by_row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), deviations.take(by_row),
                    pa.array(whitened, mask=np.tile(~live, len(x))), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, RESULT)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
