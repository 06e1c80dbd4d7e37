"""Whitening of embeddings on the leading eigenvectors of their covariance, found by spectrum slicing.

The covariance is summed over the distinct vectors in Spark. Its spectrum is sliced by inertia: a symmetric indefinite
factorisation P(V - sI)P' = L D L' has as many positive entries in D as V has eigenvalues above s (Sylvester), so bisection
on that count isolates each leading eigenvalue. Rayleigh quotient iteration from inside the slice converges cubically, and
counts on both sides of what it converges to certify the eigenvalue's number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Components returned.
LEADING = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries are held within this bound, so that x is a long with room to spare.
LARGEST = float(2**40)
#: Bunch and Kaufman's bound of growth: (1 + sqrt(17)) / 8.
PIVOT = 0.6403882032022076
#: Eigenvalues nearer than this share of the norm count as one (several times), and as 0 below it.
RELATIVE = 1e-13
#: Steps of Rayleigh quotient iteration before the slice is halved again.
STEPS = 12


def positive_count(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix a exceed shift: the positive inertia of D in L D L' = P (a - shift I) P',
    with 1x1 and 2x2 pivots chosen as Bunch and Kaufman do."""
    m = a - shift * np.eye(len(a))
    count, k, n = 0, 0, len(m)
    while k < n:
        if k == n - 1:
            return count + int(m[k, k] > 0)
        column = np.abs(m[k + 1 :, k])
        r = int(column.argmax()) + k + 1
        largest = column[r - k - 1]
        size = 1
        if abs(m[k, k]) < PIVOT * largest:
            row = np.abs(m[k:, r])
            row[r - k] = 0
            beside = row.max()
            if abs(m[k, k]) * beside < PIVOT * largest**2:
                if abs(m[r, r]) >= PIVOT * beside:
                    _swap(m, k, r)
                else:
                    _swap(m, k + 1, r)
                    size = 2
        if size == 1:
            count += int(m[k, k] > 0)
            if m[k, k] != 0:
                m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :]) / m[k, k]
        else:  # the pivot block has a negative determinant: one eigenvalue of either sign
            count += 1
            m[k + 2 :, k + 2 :] -= m[k + 2 :, k : k + 2] @ np.linalg.solve(m[k : k + 2, k : k + 2], m[k : k + 2, k + 2 :])
        k += size
    return count


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


def rayleigh(a: np.ndarray, start: np.ndarray, shift: float, found: np.ndarray) -> tuple[float, np.ndarray, bool]:
    """(eigenvalue, unit vector, converged) by Rayleigh quotient iteration, one step of it at the given shift first; the
    vectors found before (rows) are projected out."""
    norm = np.abs(a).sum(1).max()
    v, residual = start, np.inf
    for _ in range(STEPS):
        try:
            v = np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            v = np.linalg.solve(a - (shift + 1e-15 * norm) * np.eye(len(a)), v)
        for _ in range(2):
            v = v / np.linalg.norm(v)
            v = v - found.T @ (found @ v)
        v /= np.linalg.norm(v)
        shift = float(v @ a @ v)
        before, residual = residual, np.linalg.norm(a @ v - shift * v)
        if residual <= 4e-16 * norm or (residual <= 1e-12 * norm and residual >= before / 2):
            return shift, v, True
    return shift, v, False


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a positive semidefinite matrix: the `most` largest above rounding, falling.

    A slice (low, high] with the counts above its ends is halved until it holds eigenvalue j alone; the iteration's result
    must lie there and have j - 1 eigenvalues above it and j at or above it, else the slice is halved on. Eigenvalues that
    halving can't part are one eigenvalue several times; their vectors are made orthogonal one after another."""
    a = (a + a.T) / 2
    n, norm = len(a), float(np.abs(a).sum(1).max())
    if norm == 0:
        return np.zeros(0), np.zeros((0, n))
    width = RELATIVE * norm
    known = {-width: n, norm + width: 0}  # shift: eigenvalues above it
    values, vectors = np.zeros(0), np.zeros((0, n))
    rng = np.random.default_rng(11)

    def above(s: float) -> int:
        if s not in known:
            known[s] = positive_count(a, s)
        return known[s]

    for j in range(1, min(most, n) + 1):
        low = max(s for s, c in known.items() if c >= j)
        high = min(s for s, c in known.items() if c < j)
        while True:
            alone = above(low) == j and above(high) == j - 1
            if alone or high - low <= width:
                e, v, done = rayleigh(a, rng.standard_normal(n), (low + high) / 2, vectors)
                inside = low - width <= e <= high + width
                if done and inside and above(e + width) < j <= above(e - width):
                    break
                if high - low <= width / 1024:
                    raise ArithmeticError(f"eigenvalue {j} can't be certified")
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= j else (low, middle)
        if e <= n * width:
            break
        values, vectors = np.append(values, e), np.vstack([vectors, v])
    return values, vectors


def sound(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def summed_rows(kind: str, of) -> callable:
    """A mapInArrow function: sums of(x) (a matrix) over the batches of a partition, as rows (i, row)."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = of(matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["i", "row"])

    return run


def summed(fit: DataFrame, kind: str, of) -> np.ndarray:
    """The sum of of(x) over all of the fit list: partial matrices, one a partition, are added in Spark."""
    parts = fit.mapInArrow(summed_rows(kind, of), f"i int, row array<{kind}>")
    cells = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    rows = cells.collect()  # as many as the matrix has entries
    out = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1), np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r.i, r.j] = r.value
    return out


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x - sums / n, and the exact n * x - sums as n * whole - rest: whole, rest)."""
    base = sums // n
    rest = sums - n * base
    whole = x - base
    return whole - rest / n, whole, rest


def deviations(whole: np.ndarray, rest: np.ndarray, n: int) -> list:
    """Sums of squares of n * whole - rest by row, exact; None where a long can't hold one."""
    if n * (float(np.abs(whole).max(initial=0)) + 1) < 2**31 / whole.shape[1] ** 0.5 / 2:
        d = n * whole - rest
        return (d * d).sum(1).tolist()
    # sum (n w - r)^2 = n^2 sum w^2 - 2 n sum w r + sum r^2, with longs only where they surely hold the sums
    most = int(np.abs(whole).max(initial=0))
    if most**2 * whole.shape[1] < 2**62 and most * n * whole.shape[1] < 2**62:
        a, b, c = (whole * whole).sum(1).tolist(), (whole * rest).sum(1).tolist(), sum(r * r for r in rest.tolist())
        exact = [n * n * p - 2 * n * q + c for p, q in zip(a, b, strict=True)]
    else:
        exact = [sum((n * w - r) ** 2 for w, r in zip(row, rest.tolist(), strict=True)) for row in whole.tolist()]
    return [d if d < 2**63 else None for d in exact]


def whiten(vectors: DataFrame, components: int = LEADING) -> DataFrame:
    """Each vector's coordinates on the leading components of the covariance, each scaled to variance 1.

    vectors: vec_id, embedding (array); others ignored. An entry c is x = floor(64 c) + 1000000; the covariance is that of
    the distinct x vectors (the fit list, n of them with sums S), divisor n. Returns a row per vector and component, numbered
    from 1 by falling eigenvalue e: vec_id, component, n, deviation (sum of (n x - S)^2, exact), whitened ((x - S/n) on the
    component, over sqrt(e)), explained (e over the trace), identity_error (the same in all rows: the largest absolute entry
    of the fit list's whitened covariance minus the identity).

    Rows are dropped whose vector is null, empty, holds null or non-finite entries, or has another length than most (ties:
    the longer). Null ids and repeated rows: rows like others. Entries beyond +-2**40 count as that bound; a deviation that
    exceeds a long is null. Fewer dimensions, or eigenvalues above rounding, than `components`: those there are (one distinct
    vector alone: no rows). No rows: no rows. The driver holds matrices of dimension x dimension entries and nothing that
    grows with the rows.
    """
    spark = vectors.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    C.small_batches(spark)
    e = F.col("embedding").cast("array<double>")
    held = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).where(sound(F.col("v")))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(held(c) * SCALE) + SHIFT).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], kind)
    rows = rows.where(F.size("x") == sizes["dim"])
    fit = C.written(rows.select("x").distinct())  # copies are combined before the shuffle
    n = fit.count()
    sums = summed(fit, "long", lambda x: x.sum(0)[None, :])[0]
    variance = summed(fit, "double", lambda x: (lambda d: d.T @ d)(centred(x, sums, n)[0])) / n
    values, axes = leading(variance, components)
    if not len(values):
        return spark.createDataFrame([], kind)
    scaled = axes.T / np.sqrt(values)
    check = summed(fit, "double", lambda x: (lambda y: y.T @ y)(centred(x, sums, n)[0] @ scaled)) / n
    error, explained = float(np.abs(check - np.eye(len(values))).max()), values / np.trace(variance)

    def project(batches):
        k = len(values)
        for batch in batches:
            if not len(batch):
                continue
            c, whole, rest = centred(matrix(batch.column("x")), sums, n)
            many = len(c) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(c)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))),
                    pa.array(np.full(many, n)),
                    pa.array(deviations(whole, rest, n), pa.int64()).take(pa.array(np.repeat(np.arange(len(c)), k))),
                    pa.array((c @ scaled).ravel()),
                    pa.array(np.tile(explained, len(c))),
                    pa.array(np.full(many, error)),
                ],
                [x.split()[0] for x in kind.split(", ")],
            )

    return rows.mapInArrow(project, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
