"""Row counts, label histograms and class weights.

All are partial (map-side combined) aggregates: each partition sends at most
one row per key to the shuffle, so a hot task or label costs no more than a
cold one.  Windows below run on those aggregates (at most tasks x labels rows),
never on the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .examples import labelled


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per (task, split) and all totals (cube).

    ``level`` is 0 for (task, split) cells, 1 for a task over its splits, 2 for
    a split over the tasks (``train``: the train total) and 3 for all rows."""
    return (df.cube("task", "split")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
            .select("task", "split", F.col("n").cast("bigint").alias("n"),
                    F.col("level").cast("int").alias("level")))


def label_counts(examples: DataFrame) -> DataFrame:
    """Rows per (task, label) among labelled rows."""
    return (labelled(examples).groupBy("task", "label")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def class_weights(examples_or_counts: DataFrame) -> DataFrame:
    """``weight = ln(total / n_label)`` per (task, label).

    ``freq_rank`` (1 = most frequent, ties by label) reproduces the list order
    the weights were emitted in; consumers join on ``label``, never on rank.
    """
    counts = (examples_or_counts if "n" in examples_or_counts.columns
              else label_counts(examples_or_counts))
    total = F.sum("n").over(Window.partitionBy("task"))
    rank_w = Window.partitionBy("task").orderBy(F.col("n").desc(), F.col("label"))
    return counts.select(
        "task", "label", "n",
        F.log(total / F.col("n")).alias("weight"),
        F.row_number().over(rank_w).cast("int").alias("freq_rank"),
    )


def task_counts(examples: DataFrame) -> DataFrame:
    """Labelled rows per task."""
    return (labelled(examples).groupBy("task")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def task_proportions(counts: DataFrame) -> DataFrame:
    """``p = n / sum(n)`` over the per-task count table."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
