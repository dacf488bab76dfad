"""Properties of the prepare stage on the driver tables (FIXTURES.md 3)."""

import pytest
from pyspark.sql import functions as F

from braid.operators import batching as bt
from braid.operators import features as fe
from braid.plans.prepare import Prepared

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

EXPECTED = {
    SF001: {"n": (87, 67, 200), "b": (18, 14, 41), "tb": 4, "dev": (15, 11, 36), "test": (113, 47, 40)},
    SF01: {"n": (399, 436, 1000), "b": (16, 17, 39), "tb": 22, "dev": (47, 62, 142), "test": (601, 336, 40)},
}
ORDER = ("quality", "turns", "lang")


@pytest.fixture(scope="module", params=[SF001, SF01])
def prep(spark, request):
    return request.param, Prepared(spark, request.param)


def test_plan_matches_fixture(prep):
    sf, p = prep
    rows = {r["task"]: r for r in p.plan.collect()}
    e = EXPECTED[sf]
    assert tuple(rows[t]["n"] for t in ORDER) == e["n"]
    assert tuple(rows[t]["batch_size"] for t in ORDER) == e["b"]
    assert {rows[t]["train_batches"] for t in ORDER} == {e["tb"]}
    assert tuple(rows[t]["dev_n"] for t in ORDER) == e["dev"]


def test_split_complete_disjoint_and_balanced(prep):
    sf, p = prep
    c = {(r["task"], r["split"]): r["count"] for r in p.splits.groupBy("task", "split").count().collect()}
    plan = {r["task"]: r for r in p.plan.collect()}
    for i, t in enumerate(ORDER):
        assert c[(t, "dev")] == plan[t]["dev_n"]
        assert c[(t, "train")] % plan[t]["batch_size"] == 0
        assert c[(t, "train")] // plan[t]["batch_size"] == plan[t]["train_batches"]
        assert c[(t, "train")] + c[(t, "dev")] == plan[t]["n"]
        assert c[(t, "test")] == EXPECTED[sf]["test"][i]
    tr = p.splits.filter("split = 'train'").select("task", "id")
    dv = p.splits.filter("split = 'dev'").select("task", "id")
    assert tr.intersect(dv).count() == 0


def test_quota_floor_per_label(prep):
    _, p = prep
    q = p.quota.join(p.plan.select("task", F.col("n").alias("tn"), "dev_n"), "task")
    for r in q.collect():
        assert r["quota"] >= int(r["n"] * (r["dev_n"] / r["tn"]))
        assert r["quota"] <= r["n"]


def test_split_independent_of_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = {(r["task"], r["id"], r["split"]) for r in Prepared(spark, SF001, materialize=False).splits.select(
            "task", "id", "split").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = {(r["task"], r["id"], r["split"]) for r in Prepared(spark, SF001, materialize=False).splits.select(
        "task", "id", "split").collect()}
    assert one == eight


def test_batches_equal_count(spark):
    p = Prepared(spark, SF001)
    z = bt.zip_batches(bt.assign_batches(p.splits, p.plan))
    steps = {r["task"]: r["c"] for r in z.groupBy("task").agg(F.count("*").alias("c")).collect()}
    tb = p.plan.first()["train_batches"]
    assert set(steps.values()) == {tb}


def test_feature_lengths(spark):
    p = Prepared(spark, SF001)
    vocab = fe.build_vocab(p.splits)
    feats = fe.encode(p.encoded_splits(), vocab)
    chk = fe.check_lengths(feats).collect()
    assert all(r["bad_ids"] == 0 and r["bad_mask"] == 0 and r["bad_segments"] == 0 and r["bad_real"] == 0
               for r in chk)
    ids = vocab.filter("token_id < 4").orderBy("token_id").select("token").collect()
    assert [r["token"] for r in ids] == ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
