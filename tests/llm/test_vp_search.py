import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlstrata.llm import vp_search as V


def brute(vectors, every, k):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        near = sorted((float(V.distances(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.RandomState(1)
    rows = [(i, [float(np.float32(x)) for x in r.randn(8) + 3 * (i % 4)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    return rows + [(500, None), (600, [0.0] * 8), (700, [float("nan")] + [1.0] * 7), (800, [float("inf")] * 8), (900, [None] + [1.0] * 7), (None, [1.0] * 8), (510, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int")


def test_factor_one_is_exact(spark, vectors):
    got = [tuple(r) for r in V.nearest(frame(spark, vectors), every=10, shard_rows=150).orderBy("query_id", "rank").collect()]
    assert got == brute(vectors, 10, 10)


def test_smaller_factor_prunes_and_keeps_recall(spark, vectors):
    want = {(q, i) for q, _, i, _ in brute(vectors, 10, 10)}
    got = {(r["query_id"], r["vec_id"]) for r in V.nearest(frame(spark, vectors), every=10, factor=0.8).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_few_and_none(spark, vectors):
    assert V.nearest(frame(spark, [])).count() == 0
    assert V.nearest(frame(spark, vectors[:1])).count() == 0
    assert V.nearest(frame(spark, vectors[:4])).where(F.col("query_id") == 0).count() == 3
    assert V.nearest(frame(spark, [*vectors[:4], *vectors[:4]])).count() == 3


def test_few_exact_distances_in_many_dimensions(monkeypatch):
    r = np.random.RandomState(2)
    points = r.randn(3000, 48)
    points[2000:2300] = points[5] + 1e-9 * r.randn(300, 48)
    ids, asked = np.arange(3000) * 7, np.arange(0, 3000, 10)
    tree, pairs, plain = V.Tree(points, ids), [], V.distances

    def counted(a, b):
        pairs.append(math.prod(np.broadcast_shapes(a.shape[:-1], b.shape[:-1])))
        return plain(a, b)
    monkeypatch.setattr(V, "distances", counted)
    d, who = tree.search(points[asked], ids[asked], 10, 1.0)
    assert sum(pairs) < 0.25 * len(points) * len(asked)  # the triangle inequality alone leaves nearly all of them
    assert len(pairs) < 3 * len(tree.nodes)  # queries go on together: one step per node
    for i, q in enumerate(asked):
        near = plain(points[q], points)
        near[q] = np.inf
        order = np.lexsort((ids, near))[:10]
        assert np.array_equal(ids[order], who[i]) and np.array_equal(near[order], d[i])


def test_lengths_that_overflow():
    r = np.random.RandomState(3)
    points = np.where(r.rand(500, 1) < 0.3, 1e160, 1.0) * r.randn(500, 8)
    with np.errstate(all="ignore"):
        d, who = V.Tree(points, np.arange(500)).search(points[:40], np.arange(40), 5, 1.0)
        for q in range(40):
            near = V.distances(points[q], points)
            near[q] = np.inf
            order = np.argsort(near, kind="stable")[:5]
            assert np.array_equal(d[q], near[order]) and np.array_equal(np.where(np.isinf(near[order]), -1, order), who[q])
