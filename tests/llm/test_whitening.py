"""Whitening against numpy's own eigenvectors, and the inertia counts."""

import numpy as np
import pytest

from retentia.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], SCHEMA).repartition(3)


def force(vectors):
    """(ids, x vectors, distinct x vectors) of usable rows."""
    rows = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in rows]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    rows = [(i, v) for i, v in rows if len(v) == dim]
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    return [i for i, _ in rows], x, np.unique(x, axis=0)


def compare(rows, vectors, most=16):
    ids, x, fit = force(vectors)
    n, sums = len(fit), fit.sum(0)
    d = fit - sums / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:most] > 1e-9 * values[0]).sum())
    assert len(rows) == len(ids) * k and {r.component for r in rows} == set(range(1, k + 1))
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened, r.explained))
    for i, v in zip(ids, x.tolist(), strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums.tolist(), strict=True))
        mine = dict((c, (w, e)) for c, w, e in got[i, deviation])
        want = (np.array(v) - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
        assert np.allclose([abs(mine[c][0]) for c in range(1, k + 1)], np.abs(want), rtol=1e-8, atol=1e-8)
        assert np.allclose([mine[c][1] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)


def test_odd_rows_against_eigh(spark):
    rng = np.random.default_rng(3)
    spread = np.linspace(3, 0.5, 9)
    vectors = [(i, (rng.standard_normal(9) * spread).astype(np.float32).tolist()) for i in range(60)]
    vectors += [(70 + i, vectors[0][1]) for i in range(30)]  # copies count once in the fit
    vectors += [(5, vectors[5][1]), (None, vectors[6][1]), (None, vectors[7][1]), (5, vectors[8][1])]
    vectors += [(200, None), (201, []), (202, [None] * 9), (203, [float("nan")] * 9), (204, [float("inf")] + [0.0] * 8), (205, [1.0] * 4), (206, [0.0] * 9)]
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors)
    compare(whitening.whiten(frame(spark, vectors), 4).collect(), vectors, 4)


def test_the_table_against_eigh(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(whitening.query(spark, sf).collect(), [(r.vec_id, list(r.embedding)) for r in rows])


def test_few_distinct_vectors(spark):
    """Fewer components than dimensions where the fit list spans fewer; none where it is one vector."""
    vectors = [(i, [float(i % 3), 1.0, float(i % 3 == 1), 0.0]) for i in range(12)]
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [])).schema.simpleString().startswith("struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double")


def test_huge_entries_do_not_break(spark):
    rows = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 3.0])])).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(r.deviation is None or r.deviation >= 0 for r in rows)
    assert whitening.deviations(np.array([[2**44, -3]]), np.array([1, 0]), 3) == [None]
    assert whitening.deviations(np.array([[2**30, -3]]), np.array([1, 0]), 2) == [(2 * 2**30 - 1) ** 2 + 36]


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_inertia_counts(n):
    rng = np.random.default_rng(n)
    for zero_diagonal in (False, True):
        a = rng.standard_normal((n, n))
        a += a.T
        if zero_diagonal:
            np.fill_diagonal(a, 0)
        w = np.linalg.eigvalsh(a)
        for s in rng.uniform(-8, 8, 40):
            assert whitening.positive_count(a, s) == (w > s).sum()


def test_clusters_of_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((20, 20)))[0]
    w = np.array([7.0, 7, 7, 4, 4 - 1e-10, 2] + [1.0] * 4 + [0.0] * 10)
    values, axes = whitening.leading(q @ np.diag(w) @ q.T, 16)
    assert np.allclose(values, w[:10], atol=1e-12)
    assert np.allclose(axes @ axes.T, np.eye(10), atol=1e-10)
    assert np.allclose(q @ np.diag(w) @ q.T @ axes.T, axes.T * values, atol=1e-10)
