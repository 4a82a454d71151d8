"""Whitening against numpy on the same centred rows, and against exact whole-number arithmetic."""

import math

import numpy as np

from sqlstrata.llm import whitening

TYPES = "vec_id long, embedding array<float>, label int, x int, n int, component int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in vectors], TYPES)


def cloud(n=300, d=20, seed=3):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(3, 0.2, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0]


def codes(v):
    return [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]


def test_against_numpy(spark):
    rows = cloud()
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(rows)]
    vectors += [(1000, vectors[0][1]), (1000, vectors[0][1]), (None, vectors[5][1]), (2000, None), (2001, [float("nan")] + vectors[0][1][1:]), (2002, [None] + vectors[0][1][1:]), (2003, [float("inf")] * 20), (2004, []), (2005, [1.0, 2.0])]
    got = whitening.whiten(table(spark, vectors)).toPandas()
    x = np.array(sorted({tuple(codes(v)) for _, v in vectors[:300]}), float)
    n = len(x)
    centred = x - x.mean(0)
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    assert sorted(got.vec_id.dropna().astype(int).unique()) == [*range(300), 1000] and len(got) == 303 * 16
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    one = got[got.vec_id == 7].sort_values("component")
    want = (np.array(codes(vectors[7][1])) - x.mean(0)) @ w[:, :16] / np.sqrt(e[:16])
    assert np.allclose(np.abs(one.whitened), np.abs(want), atol=1e-8) and np.allclose(one.explained, e[:16] / e.sum(), rtol=1e-9)
    whole = [[int(a) for a in v] for v in x]
    s = [sum(c) for c in zip(*whole)]
    assert set(one.deviation) == {sum((n * a - b) ** 2 for a, b in zip(codes(vectors[7][1]), s))}
    same = got[got.vec_id == 1000].whitened.to_numpy()
    assert np.allclose(np.sort(same)[::2], np.sort(same)[1::2])


def test_ill_conditioned(spark):
    """Eigenvalues twelve orders apart keep their relative accuracy, which a decomposition of the covariance would lose."""
    r = np.random.default_rng(1)
    wide = np.round(r.normal(size=200) * 1e6)
    rows = [(i, [float(a), float(r.integers(0, 3)) / 64, float(r.integers(0, 3)) / 64]) for i, a in enumerate(wide)]
    got = whitening.whiten(table(spark, rows)).toPandas()
    x = np.array([codes(v) for _, v in rows], float)
    x = np.unique(x, axis=0)
    centred = x - x.mean(0)
    want = np.linalg.svd(centred, compute_uv=False) ** 2
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, want / want.sum(), rtol=1e-6) and got.identity_error.max() < 1e-4


def test_flat_directions_and_empty_tables(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 5) * 2, float(i % 3)]) for i in range(40)]
    got = whitening.whiten(table(spark, rows)).toPandas()
    assert got.component.max() == 2 and got.identity_error.max() < 1e-9  # two of four dimensions vary on their own
    assert whitening.whiten(table(spark, rows[:1])).count() == 0
    assert whitening.whiten(table(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_deviation_beyond_a_long():
    centre = whitening.Centred(3, [0, 3 << 40])
    x = np.array([[1, 1 << 40], [1 << 40, 1 << 40], [5, (1 << 40) + 1]])
    assert centre.deviation(x) == [9, None, 225 + 9]


def test_solves_are_inverses():
    r = np.triu(np.random.default_rng(0).normal(size=(9, 9))) + 4 * np.eye(9)
    q = np.random.default_rng(1).normal(size=(30, 9))
    assert np.allclose(whitening.solved(q, r) @ r, q)
