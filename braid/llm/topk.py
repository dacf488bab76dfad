"""Exact top-k inner-product search with Fagin's threshold algorithm.

The candidate vectors are dealt into blocks by a hash of their id, the queries
into blocks as well, and every (candidate block, query block) pair is one group.
Inside a block each dimension has a list of the vectors sorted by that
component.  A query reads its lists from the end its sign favours, in rounds of
growing depth: vectors seen for the first time are scored exactly, and the sum
over the dimensions of query component times the component at the current depth
bounds every vector not seen yet.  The search of a block stops when that bound
is below the kth score found so far.  The block results (k rows per query and
block) meet in one ranked window, which Spark limits before the shuffle.

Defined results.  Components are floor(1024 * x); a null vector, or one holding
a null or non-finite component, takes no part; an empty vector scores 0; shorter vectors
count as padded with zeros.  Rows with a null id take no part.  A repeated id is
a candidate once per row, and no row is a candidate of a query with its own id;
a repeated query id is searched once, with the smallest of its vectors.  Ties
go to the smaller id.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, ship_package

SCALE = 1024
# Rows per block: a candidate block is at most well under a MB.
CANDIDATES_PER_BLOCK = 1024
QUERIES_PER_BLOCK = 1024
FIRST_DEPTH = 32
OUT = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (``id``, ``v`` array of long) of the vectors that take part."""
    x = F.col("x").cast("array<double>")
    ok = (F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).filter(ok)
            .select("id", F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v")))


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    """Vectors as one matrix padded with zeros to ``dims`` columns."""
    m = np.zeros((len(rows), dims), dtype=np.int64)
    for i, v in enumerate(rows):
        m[i, :len(v)] = v
    return m


def _threshold_search(q: np.ndarray, qid: int, ids: np.ndarray, m: np.ndarray, dot, order: np.ndarray,
                      k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of one block, best first."""
    n, active = len(ids), np.flatnonzero(q)
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.ones(n, bool)
    down = q[active] > 0
    at, depth = 0, FIRST_DEPTH
    while at < n:
        to = min(n, at + depth) if len(active) else n
        if len(active):
            hit = np.zeros(n, bool)
            # A list is read from its large end for a positive component, else from its small end.
            hit[order[active[down], n - to:n - at]] = True
            hit[order[active[~down], at:to]] = True
            new = np.flatnonzero(hit & fresh)
        else:
            new = np.arange(n)
        fresh[new] = False
        new = new[ids[new] != qid]
        best_ids, best = np.append(best_ids, ids[new]), np.append(best, dot(new, q))
        if len(best) > k:
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        at, depth = to, depth * 2
        if at < n and len(best) >= k:
            edge = np.where(down, order[active, n - at], order[active, at - 1])
            if int((m[edge, active] * q[active]).sum()) < best[-1]:
                break
        if not fresh.any():
            break
    return best_ids, best


def _search_blocks(k: int):
    def search(key, cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(cands["v"].map(len).max(), queries["v"].map(len).max())
        ids, m = cands["id"].to_numpy(np.int64), _matrix(cands["v"], dims)
        qs = _matrix(queries["v"], dims)
        order = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
        exact = float(np.abs(m).max(initial=0)) * float(np.abs(qs).max(initial=0)) * max(1, dims) < 2.0 ** 53
        f = m.astype(np.float64) if exact else None  # products of this size are exact in doubles

        def dot(rows, q):
            return (f[rows] @ q.astype(np.float64)).astype(np.int64) if exact else m[rows] @ q
        out = []
        for qid, q in zip(queries["id"].to_numpy(np.int64), qs, strict=True):
            got, scores = _threshold_search(q, qid, ids, m, dot, order, k)
            out.append(np.column_stack([np.full(len(got), qid), got, scores]))
        r = np.concatenate(out)
        return pd.DataFrame({"query_id": r[:, 0], "vec_id": r[:, 1], "score": r[:, 2]})
    return search


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best candidates of
    every query (both tables: ``id``, ``v`` as made by ``quantise``)."""
    ship_package(candidates.sparkSession)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_c = blocks_for(candidates.count(), CANDIDATES_PER_BLOCK)
    n_q = blocks_for(queries.count(), QUERIES_PER_BLOCK)
    h = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.select("id", "v", h(n_c).alias("cb")).withColumn("qb", every(n_q))
    q = queries.select("id", "v", h(n_q).alias("qb")).withColumn("cb", every(n_c))
    found = (c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb"))
             .applyInPandas(_search_blocks(k), OUT))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
