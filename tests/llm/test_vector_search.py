from __future__ import annotations

import math

import numpy as np
import pytest

from skylattice.llm import block_search, pivot_search


def table(spark, n=900, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:80] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [1.0] * (dim - 1) + [math.nan]), (2003, [1.0, None]), (2004, [math.inf] * dim), (None, [1.0] * dim), (2100, [0.0] * dim)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


def test_exact_top_k(spark):
    x, df = table(spark)
    v = np.vstack([np.floor(256 * x.astype(float)), np.zeros((1, x.shape[1]))])
    ids = [*range(len(x)), 2100]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivot_search.exact_top_k(spark, df, 5, 50).collect()}
    want = {}
    for a, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted((-int(v[a] @ v[b]), j) for b, j in enumerate(ids) if b != a)[:5]
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want


def test_large_numbers_stay_exact(spark):
    big = [float(1 << 22)] * 3
    df = spark.createDataFrame([(0, big), (1, [x + i for i, x in enumerate(big)]), (2, big)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in pivot_search.exact_top_k(spark, df, 5, 50).orderBy("rank").collect()]
    v = [[math.floor(256 * x) for x in u] for u in (big, [x + i for i, x in enumerate(big)], big)]
    assert got == [(1, sum(a * b for a, b in zip(v[0], v[1]))), (2, sum(a * a for a in v[0]))]


def test_nearest_is_exact(spark):
    x, df = table(spark)
    d = x.astype(float)
    got = {}
    for r in block_search.nearest(spark, df, 10, 100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 900, 100))
    for q, own in got.items():
        exact = block_search.true_distances(np.broadcast_to(d[q], d.shape), d)
        best = sorted((s, j) for j, s in enumerate(exact.tolist()) if j != q)[:10]
        assert [own[k + 1] for k in range(10)] == [(j, s) for s, j in best]


def brute_top(x, ids, every, k):
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            best = sorted((-int(x[a] @ x[b]), j) for b, j in enumerate(ids) if j != i)[:k]
            out |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_many_blocks_and_ranges(spark, monkeypatch):
    """Small blocks, so that the grid, the two passes, and pruning are used; clusters, and a third of all vectors alike."""
    for name, n in (("ROWS", 32), ("QUERIES", 8)):
        for module in (pivot_search, block_search):
            monkeypatch.setattr(module, name, n)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(12, 8)) * 4, 100, axis=0) + rng.normal(size=(1200, 8)) * 0.2
    x[800:] = x[800]
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    v, ids = np.floor(256 * x), list(range(1200))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivot_search.exact_top_k(spark, df, 5, 50).collect()}
    assert got == brute_top(v, ids, 50, 5)
    near = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in block_search.nearest(spark, df, 10, 100).collect()}
    for q in range(0, 1200, 100):
        exact = block_search.true_distances(np.broadcast_to(x[q], x.shape), x)
        best = sorted((s, j) for j, s in enumerate(exact.tolist()) if j != q)[:10]
        assert [near[(q, n + 1)] for n in range(10)] == [(j, s) for s, j in best]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(20, 6)) * 100, rng.normal(size=(300, 6)) * 100
    p = pivot_search.choose_pivots(x, 4)
    d = pivot_search.distances(x, p)
    part = d.argmin(1)
    for i in range(4):
        own, dist = x[part == i], d[part == i, i]
        b = pivot_search.bounds(q, pivot_search.distances(q, p[i : i + 1]), dist.min(keepdims=True), dist.max(keepdims=True), (own * own).sum(1).max(keepdims=True))
        assert (b[:, 0] >= (q @ own.T).max(1)).all()


def test_odd_vectors(spark):
    """Repeated ids and rows, columns with clashing names, and scores beyond a long."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, dim int, part int, unit string")
    top = sorted((r["rank"], r["vec_id"], r["score"]) for r in pivot_search.exact_top_k(spark, df).collect())
    q = np.floor(256 * np.array([0.5, 9.0]))  # of id 0, the smallest vector asks
    a, b = int(q @ [768, 256]), int(q @ [256, 256])
    assert top == [(1, 1, a), (2, 1, a), (3, 2, b)]
    near = sorted((r["rank"], r["vec_id"]) for r in block_search.nearest(spark, df).collect())
    assert near == [(1, 1), (2, 1), (3, 2)] or near == [(1, 2), (2, 1), (3, 1)]
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="long"):
        pivot_search.exact_top_k(spark, huge).collect()


def test_empty_and_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in block_search.nearest(spark, df).collect()] == [(0, 1, 3, 0.0)]
    assert pivot_search.exact_top_k(spark, df).count() == 1
    assert block_search.nearest(spark, df.limit(0)).count() == 0 and pivot_search.exact_top_k(spark, df.limit(0)).count() == 0
