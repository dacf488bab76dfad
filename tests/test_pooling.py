"""Pooling over sequences of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.operators import heads as hd


def plain_attention(x, w):
    s = x @ w
    a = np.exp(s - s.max())
    return np.maximum((a / a.sum()) @ x, 0)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_blocks_do_not_matter(spark, block):
    g = np.random.default_rng(1)
    x = {s: g.normal(0, 3, (n, 3)) for s, n in enumerate((1, 2, 7, 40, 133))}
    rows = [(s, int(p), [float(v) for v in x[s][p]]) for s in x for p in g.permutation(len(x[s]))]
    rows += [(0, 99, None), (9, 0, None)]  # no vector, no part; a sequence of such has no row
    df = spark.createDataFrame(rows, "seq_id long, pos int, embedding array<double>").repartition(3)
    w = [0.5, -1.0, 2.0]
    got = {r.seq_id: r.pooled for r in hd.pool_attention(df, w, block).collect()}
    top = {r.seq_id: r.pooled for r in hd.pool_max(df, block).collect()}
    assert got.keys() == top.keys() == x.keys()
    for s in x:
        assert np.allclose(got[s], plain_attention(x[s], np.array(w)))
        assert np.allclose(top[s], x[s].max(axis=0))
    mixed = df.filter("embedding IS NOT NULL").select("seq_id", F.col("embedding")[0].alias("gate"), F.col("embedding").alias("logits"))
    for r in hd.mix_heads(mixed, block=block).collect():
        a = np.exp(x[r.seq_id][:, 0] - x[r.seq_id][:, 0].max())
        assert np.allclose(r.logits, (a / a.sum()) @ x[r.seq_id])


def test_a_hundred_thousand_positions(spark):
    """One sequence, every position alike but one; and scores too large for a plain exponential."""
    n = 100_000
    df = spark.range(0, n, 1, 8).select(
        F.lit(5).cast("long").alias("seq_id"), F.col("id").alias("pos"),
        F.when(F.col("id") == 77_777, F.array(F.lit(900.0), F.lit(3.0))).otherwise(F.array(F.lit(890.0), F.lit(1.0))).alias("embedding"))
    got = hd.pool_attention(df, [1.0, 0.0]).first().pooled
    share = 1 / (1 + (n - 1) * np.exp(-10.0))
    assert np.allclose(got, [900 * share + 890 * (1 - share), 3 * share + (1 - share)])
    assert hd.pool_attention(df.limit(0), [1.0, 0.0]).collect() == []


def test_no_group_is_large(spark):
    """Every round collects about a block, whatever the sequence holds."""
    sizes = []

    def merge(states):
        return F.struct(F.aggregate(states, F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n"),
                        F.greatest(F.size(states), F.array_max(F.transform(states, lambda s: s["most"]))).alias("most"))
    members = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).alias("most")).alias("state"))
    for r in hd.folded(members, "k", merge, 32).collect():
        sizes.append(r.state.most)
        assert r.state.n == 25_000
    assert max(sizes) <= 3 * 32
