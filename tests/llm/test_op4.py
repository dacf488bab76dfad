"""Top-k search against a full sort of exact integer products."""

import math

import numpy as np
import pytest

from braid.llm import topk


def brute(rows, k, every=100):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != q)[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def got(spark, rows, k):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string")
    q = topk.quantise(df.repartition(3))
    return sorted(map(tuple, topk.top_k(q, q.filter("id % 100 = 0"), k).collect()))


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_random(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    g = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in g.normal(0, 0.2, dims).round(2)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector again and again: ties everywhere
    assert got(spark, rows, 10) == brute(rows, 10)


def test_stops_early():
    """With one strong dimension the bound ends the search before the lists do."""
    g = np.random.default_rng(0)
    m = g.integers(-5, 6, (4000, 4))
    m[:, 0] = g.permutation(4000) * 100
    order, seen = np.argsort(m, axis=0, kind="stable").T.astype(np.int32), []

    def dot(rows, q):
        seen.extend(rows)
        return m[rows] @ q
    q = np.array([3, 1, -1, 0])
    ids, scores = topk._threshold_search(q, -1, np.arange(4000), m, dot, order, 10)
    want = sorted(zip(-(m @ q), range(4000), strict=True))[:10]
    assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want and len(seen) < 2000


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, [float("nan"), 1.0]), (200, [float("inf")]), (300, None), (400, []), (500, [1.0, None]),
            (None, [1.0, 1.0]), (1, [0.5]), (2, [-0.0005, 3.0, 9.0]), (0, [0.5, 0.5]), (3, [0.0, 0.0]), (3, [0.0, 0.0]),
            (600, [0.0, 0.0]), (-100, [3e4, -3e4])]
    assert got(spark, rows, 10) == brute(rows, 10)
    assert got(spark, [], 10) == [] and got(spark, [(0, [1.0])], 10) == []
