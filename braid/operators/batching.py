"""Seeded shuffles, fixed-size batches, lockstep zip and positional ids
(E2, E3, E10, C2).

Positions inside a (task, split) are exact global ranks (``plans.ranking``): shuffled rows
are bucketed by their md5 key, rows in id order are sorted into sampled ranges, so no group is ever ranked in a
single task.  Batches are then a pure column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPLIT_SEED, TASKS
from ..plans.ranking import hex_bucket, range_rank, two_stage_rank
from .common import order_key


def shuffle_order(df: DataFrame, seed: int = SPLIT_SEED, epoch: int = 1) -> DataFrame:
    """Per-epoch order key ``md5(id | seed | epoch)`` (train/dev)."""
    return df.withColumn("_key", order_key("id", seed, epoch))


def positions(df: DataFrame, part_cols=("task", "split"), seed: int = SPLIT_SEED, epoch: int = 1,
              shuffled: bool = True, out: str = "pos") -> DataFrame:
    """1-based position of every row inside ``part_cols``; shuffled rows are
    ordered by the epoch key, others by id."""
    if shuffled:
        k = shuffle_order(df, seed, epoch)
        return two_stage_rank(k, part_cols, ["_key", "id"], hex_bucket("_key"), out).drop("_key")
    return range_rank(df, part_cols, ["id"], out)


def assign_batches(splits: DataFrame, plan: DataFrame, seed: int = SPLIT_SEED, epoch: int = 1) -> DataFrame:
    """``batch_id = (pos - 1) // batch_size`` per (task, split).

    Train and dev are shuffled per epoch; test keeps id order (as a loader
    without shuffling would).  ``plan`` has one row per task (broadcast)."""
    b = F.broadcast(plan.select("task", "batch_size"))
    sh = positions(splits.filter(F.col("split") != "test"), seed=seed, epoch=epoch)
    te = positions(splits.filter(F.col("split") == "test"), shuffled=False)
    both = sh.unionByName(te).join(b, "task")
    return both.withColumn("batch_id", F.floor((F.col("pos") - 1) / F.col("batch_size")).cast("bigint"))


def submission_positions(test_rows: DataFrame) -> DataFrame:
    """0-based row position per task in id order."""
    return (positions(test_rows, ("task",), shuffled=False, out="_p")
            .withColumn("position", (F.col("_p") - 1).cast("bigint")).drop("_p"))


def zip_batches(batched: DataFrame, split: str = "train", tasks=None) -> DataFrame:
    """Lockstep steps across tasks; a step exists only when every task has
    a batch with that id (the zip stops at the shortest task).

    Output: one row per (step, task) with the batch's row count and id sum.
    Works on the per-batch aggregate (rows / batch size), never on rows.
    """
    names = [t.name for t in TASKS] if tasks is None else list(tasks)
    per = (batched.filter((F.col("split") == split) & F.col("task").isin(names))
           .groupBy("task", "batch_id")
           .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum("id").cast("bigint").alias("id_sum")))
    full = (per.groupBy("batch_id").agg(F.countDistinct("task").alias("_nt"))
            .filter(F.col("_nt") == len(names)).select("batch_id"))
    return (per.join(full, "batch_id")
            .select((F.col("batch_id") + 1).cast("bigint").alias("step"), "task", "n_rows", "id_sum"))
