"""Rows of the training log's blocks, picked by cut-offs, against ranking every row."""

from pyspark.sql import functions as F

from braid.config import SPLIT_SEED
from braid.operators.common import order_key
from braid.plans.training import Training

from tests.conftest import SF001


def test_blocks_hold_the_rows_of_their_steps(spark):
    t = Training(spark, SF001)
    feats, cuts = t.features().cache(), t.cuts()
    every, per_epoch = t.periods()
    ranked = t.steps_of(t.epochs()).select("task", "epoch", "id", "step").collect()
    for epoch in range(1, t.n_epochs + 1):
        seen = []
        for part in range(1, per_epoch + 2):
            rows = t.part_rows(feats, cuts, epoch, part).select("task", "epoch", "id").collect()
            want = {(r.task, r.epoch, r.id) for r in ranked if r.epoch == epoch and min(-(-r.step // every), per_epoch + 1) == part}
            assert {tuple(r) for r in rows} == want and len(rows) == len(want)
            seen += rows
        assert len(seen) == len({tuple(r) for r in seen})


def test_features_do_not_move_to_be_dealt_into_blocks(spark):
    """Rows with their features were shuffled once per epoch and stored once per epoch before."""
    t = Training(spark, SF001)
    rows = t.part_rows(t.features(), t.cuts(), 2, 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # What is grouped are the cut-offs, a row for each task and part.
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    key = order_key("id", SPLIT_SEED, 2)
    assert rows.join(t.cuts().filter("epoch = 2 AND part = 1"), "task").filter(key > F.col("upto._key")).isEmpty()


def test_norm_is_computed_once_a_row(spark):
    """A row of 20,000 tokens; with the norm inside the function of the elements it takes 400,000,000 steps."""
    import time

    from braid.operators import gradient as gr
    one = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct(
        i.cast("string").alias("token"), F.lit(2).cast("bigint").alias("cnt"), (i % gr.FEATURES).alias("slot")))
    rows = spark.range(4).select("id", one.alias("counts")).localCheckpoint()
    began = time.time()
    got = gr.counted_features(rows, gr.FEATURES).select(F.aggregate("value", F.lit(0.0), lambda a, v: a + v * v).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in got) and time.time() - began < 20
