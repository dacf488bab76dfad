"""Balanced split plan, per-label dev quotas and the stratified split
(D6, D7, E1, C6, C7, F1, F2, F4).

The plan and quota tables have one row per task / per (task, label); they are
computed from partial aggregates and broadcast to the rows after a size check.
The stratified split ranks rows by a deterministic md5 key; to avoid ranking a
whole label group in one task, rows are bucketed by a key prefix, buckets are
counted, and only the single *boundary* bucket per (task, label) -- the one
the quota ends in -- is ranked with a window.  All other rows are classified
by comparing their bucket with the boundary, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_DEV_PCT, SPLIT_SEED, TOTAL_BATCH_SIZE
from ..plans.ranking import HEX_PREFIX, bucket_offsets
from .common import checked_broadcast, order_key
from .examples import labelled, task_dim


def split_plan(counts: DataFrame, tasks: DataFrame, batch_size: int = TOTAL_BATCH_SIZE,
               min_pct: float = MIN_DEV_PCT) -> DataFrame:
    """Per-task batch size, batch counts and dev size.

    ``counts``: (task, n) labelled rows per task.  ``tasks``: (task, task_idx)
    decides ties ("first task wins").  Batch sizes are
    ``round_half_even(batch_size * n / total)``; the task with the fewest
    batches fixes ``dev_batches = floor(n * min_pct) // b`` and every task keeps
    ``train_batches = min_batches - dev_batches`` batches for training.  A task
    whose batch size rounds to 0 fails the query with its name.
    """
    all_w = Window.partitionBy()  # at most one row per task
    df = (counts.join(F.broadcast(tasks.select("task", "task_idx")), "task")
          .withColumn("p", F.col("n") / F.sum("n").over(all_w))
          .withColumn("b0", F.bround(F.lit(float(batch_size)) * F.col("p"), 0).cast("bigint"))
          .withColumn("batch_size", F.when(
              F.col("b0") > 0, F.col("b0")).otherwise(F.raise_error(F.concat(
                  F.lit("batch size of task "), F.col("task"),
                  F.lit(" rounds to 0; raise the total batch size"))).cast("bigint")))
          .withColumn("n_batches", F.floor(F.col("n") / F.col("batch_size")).cast("bigint")))
    key = F.struct(F.col("n_batches"), F.col("task_idx"))
    df = (df.withColumn("min_n", F.min_by("n", key).over(all_w))
          .withColumn("min_b", F.min_by("batch_size", key).over(all_w))
          .withColumn("min_batches", F.min(key).over(all_w)["n_batches"])
          .withColumn("dev_batches", F.floor(
              F.floor(F.col("min_n") * F.lit(float(min_pct))) / F.col("min_b")).cast("bigint"))
          .withColumn("train_batches", (F.col("min_batches") - F.col("dev_batches")).cast("bigint"))
          .withColumn("dev_n", (F.col("n") - F.col("train_batches") * F.col("batch_size")).cast("bigint")))
    return df.select("task", "task_idx", "n", "batch_size", "n_batches", "train_batches", "dev_n",
                     (F.col("dev_n") / F.col("n")).alias("dev_fraction"))


def label_quota(lcounts: DataFrame, plan: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Dev rows per (task, label).

    ``quota0 = floor(n_label * dev_n / n)``; the leftover up to ``dev_n`` goes
    to labels in md5(label | seed) order, each taking at most its spare rows
    (n_label - quota0), so the total is exactly ``dev_n``.
    """
    df = lcounts.join(F.broadcast(plan.select("task", F.col("n").alias("task_n"), "dev_n")), "task")
    df = (df.withColumn("quota0", F.floor(F.col("n") * (F.col("dev_n") / F.col("task_n"))).cast("bigint"))
          .withColumn("spare", F.col("n") - F.col("quota0"))
          .withColumn("leftover", F.col("dev_n") - F.sum("quota0").over(Window.partitionBy("task")))
          .withColumn("_k", F.md5(F.concat(F.col("label"), F.lit(f"|{seed}")))))
    w = (Window.partitionBy("task").orderBy("_k", "label")
         .rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("spare_before", F.coalesce(F.sum("spare").over(w), F.lit(0)))
    extra = F.least(F.col("spare"), F.greatest(F.lit(0), F.col("leftover") - F.col("spare_before")))
    return df.select("task", "label", "n", (F.col("quota0") + extra).cast("bigint").alias("quota"))


def split_keys(examples: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Labelled rows without their texts: ``task``, ``id``, ``label`` and the
    order key ``_key`` (md5 of id and seed) that the split ranks by."""
    return labelled(examples).select("task", "id", "label").withColumn("_key", order_key("id", seed))


def cutoffs(keys: DataFrame, quota: DataFrame, prefix: int = HEX_PREFIX) -> DataFrame:
    """Per (task, label): ``full_upto``, the last bucket of keys wholly inside
    the quota, and (``cut_key``, ``cut_id``), the last row inside it.

    Buckets are counted; only the one bucket the quota ends in is ranked.
    """
    keyed = keys.withColumn("_bkt", F.substring("_key", 1, prefix))
    off = bucket_offsets(keyed, ["task", "label"], "_bkt").join(
        quota.select("task", "label", "quota"), ["task", "label"])
    full = F.col("_off") + F.col("_bn") <= F.col("quota")
    edge = (F.col("_off") < F.col("quota")) & ~full
    cut = checked_broadcast(off.groupBy("task", "label").agg(
        F.max(F.when(full, F.col("_bkt"))).alias("full_upto"),
        F.max(F.when(edge, F.col("_bkt"))).alias("edge_bkt"),
        F.max(F.when(edge, F.col("quota") - F.col("_off"))).alias("need")))
    w = Window.partitionBy("task", "label").orderBy("_key", "id")
    last = (keyed.join(cut, ["task", "label"]).filter(F.col("_bkt") == F.col("edge_bkt"))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == F.col("need"))
            .select("task", "label", F.col("_key").alias("cut_key"), F.col("id").alias("cut_id")))
    return cut.join(last, ["task", "label"], "left").select("task", "label", "full_upto", "cut_key", "cut_id")


def stratified_split(examples: DataFrame, quota: DataFrame, seed: int = SPLIT_SEED,
                     prefix: int = HEX_PREFIX, keys: DataFrame | None = None) -> DataFrame:
    """Labelled rows with ``split`` = dev | train.

    Within each (task, label), rows ordered by ``md5(id | seed)`` (ties by id)
    take dev until the label's quota is met; the rest is train.  Equal to the
    plain ``row_number() <= quota`` window.  The cut-offs come from ``keys``
    (no texts); the rows themselves are read once and compared with them.
    """
    cut = checked_broadcast(cutoffs(keys if keys is not None else split_keys(examples, seed), quota, prefix))
    rows = labelled(examples).withColumn("_key", order_key("id", seed)).join(cut, ["task", "label"])
    dev = (F.coalesce(F.substring("_key", 1, prefix) <= F.col("full_upto"), F.lit(False))
           | F.coalesce((F.col("_key") < F.col("cut_key"))
                        | ((F.col("_key") == F.col("cut_key")) & (F.col("id") <= F.col("cut_id"))), F.lit(False)))
    return (rows.withColumn("split", F.when(dev, "dev").otherwise("train"))
            .select(*[c for c in examples.columns if c != "kind"], "split"))


def anti_split(rows: DataFrame, dev: DataFrame, keys=("task", "id")) -> DataFrame:
    """The rows whose key is not in ``dev`` (the train side of any dev set)."""
    return rows.join(dev.select(*keys).distinct(), list(keys), "left_anti")


def split_examples(examples: DataFrame, batch_size: int = TOTAL_BATCH_SIZE,
                   min_pct: float = MIN_DEV_PCT, seed: int = SPLIT_SEED, lcounts: DataFrame | None = None,
                   keep=lambda d: d, keys: DataFrame | None = None):
    """L1 steps 2-4: plan, quotas and the split of labelled rows; test rows
    are appended with split = 'test'.  Returns (splits, plan, quota).

    Everything small derives from the text-free ``keys`` and their label
    counts; ``keep`` may materialise plan and quota before the split reads
    them, so the split job does not recompute them."""
    spark = examples.sparkSession
    keys = keys if keys is not None else split_keys(examples, seed)
    lc = lcounts if lcounts is not None else key_counts(keys)
    tc = lc.groupBy("task").agg(F.sum("n").cast("bigint").alias("n"))
    plan = keep(split_plan(tc, task_dim(spark), batch_size, min_pct))
    quota = keep(label_quota(lc, plan, seed))
    lab = stratified_split(examples, quota, seed, keys=keys)
    test = (examples.filter(F.col("kind") == "test").drop("kind")
            .withColumn("split", F.lit("test")))
    return lab.unionByName(test), plan, quota


def key_counts(keys: DataFrame) -> DataFrame:
    """D2 from the key table: rows per (task, label)."""
    return keys.groupBy("task", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def split_check(splits: DataFrame, examples: DataFrame) -> DataFrame:
    """per task, labelled rows vs train + dev rows, and the overlap of
    train and dev ids (must be 0)."""
    lab = labelled(examples).groupBy("task").agg(F.count(F.lit(1)).alias("n_labelled"))
    sp = (splits.filter(F.col("split") != "test").groupBy("task").agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("split") == "dev", 1).otherwise(0)).alias("n_dev")))
    tr = splits.filter(F.col("split") == "train").select("task", "id")
    dv = splits.filter(F.col("split") == "dev").select("task", "id")
    overlap = tr.intersect(dv).groupBy("task").agg(F.count(F.lit(1)).alias("n_overlap"))
    return (lab.join(sp, "task", "left").join(overlap, "task", "left")
            .select("task", F.col("n_labelled").cast("bigint"),
                    F.coalesce("n_train", F.lit(0)).cast("bigint").alias("n_train"),
                    F.coalesce("n_dev", F.lit(0)).cast("bigint").alias("n_dev"),
                    F.coalesce("n_overlap", F.lit(0)).cast("bigint").alias("n_overlap")))
