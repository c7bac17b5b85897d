"""Nearest neighbours of a set of queries against all pairs."""

import math

import numpy as np
import pytest

from tessera.operators import vectors

SHAPE = "embedding array<float>"


def brute(corpus, queries, k):
    unit = lambda v: np.array(v, np.float32).astype(np.float64) / max(math.sqrt(sum(float(np.float32(x)) ** 2 for x in v)), 1e-300)
    whole = lambda v: v is not None and all(x is not None and x == x for x in v)
    rows = [(i, unit(v)) for i, v in corpus if i is not None and whole(v)]
    out = set()
    for q, v in queries:
        if q is not None and whole(v):
            best = sorted((-round(float(unit(v) @ u), 9) + 0.0, i) for i, u in rows if i != q)[:k]
            out |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
    return out


def run(spark, corpus, queries, k, **sizes):
    got = vectors.nearest_to_each(spark.createDataFrame(corpus, f"vec_id long, {SHAPE}"), spark.createDataFrame(queries, f"query_id long, {SHAPE}"), k, **sizes)
    return {(r.query_id, r.vec_id, r.rank) for r in got.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    points = np.concatenate([c + 0.05 * rng.normal(size=(60, 12)) for c in centres]).astype(np.float32)
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("block,slice_,k", [(10, 50, 3), (1000, 1 << 17, 1), (4, 1000, 7), (10, 50, 600)])
def test_equals_all_pairs(spark, clustered, block, slice_, k):
    queries = clustered[::7]
    assert run(spark, clustered, queries, k, block=block, slice_=slice_) == brute(clustered, queries, k)


def test_far_cells_are_not_visited(spark, clustered):
    rows = spark.createDataFrame(clustered, f"vec_id long, {SHAPE}")
    queries = rows.where("vec_id % 5 = 0")
    pivots = vectors._pivots(rows, 16)
    sizes, reach = vectors._bounds(queries, rows, pivots, 3)
    sent = vectors._sent(rows, pivots, np.ones(16, np.int64), np.where(sizes > 0, reach, -np.inf)).count()
    assert sizes.sum() == queries.count() and sent < 0.5 * len(clustered) * (sizes > 0).sum()


def test_odd_vectors(spark):
    nan = float("nan")
    corpus = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [3.0, 0.0]), (9, [0.0, 0.0])]
    queries = [(1, [1.0, 0.0]), (3, [0.0, 0.0]), (20, [0.0, 5.0]), (21, None), (None, [1.0, 0.0]), (22, [nan, 0.0])]
    for block in (1, 2, 100):
        assert run(spark, corpus, queries, 3, block=block, slice_=2) == brute(corpus, queries, 3)
    zeros = [(3, [0.0, 0.0]), (9, [0.0, 0.0])]
    assert run(spark, zeros, queries, 2) == brute(zeros, queries, 2)
    assert run(spark, [], queries, 2) == run(spark, corpus, [], 2) == set()
