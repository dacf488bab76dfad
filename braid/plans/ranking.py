"""Exact per-group ranks without a single-partition window.

A plain ``row_number().over(partitionBy(task).orderBy(key))`` sends a whole
group (a task may hold a third of all rows) to one task.  The two-stage form
splits every group into *order buckets* -- a coarse prefix of the order key,
monotone in the order -- ranks rows locally inside (group, bucket), counts the
buckets, and adds the running count of earlier buckets.  The result equals the
plain window.

Where the order has no such prefix (a count and a token, an id), ``range_rank`` takes
split points sampled from the order itself: rows are sorted into ranges, and a row's rank is
its place in its range plus the rows of its group in earlier ranges.

The bucket-offset table has at most ``groups x buckets`` rows; ``groups`` is
bounded by configuration (tasks x splits or tasks x labels) and ``buckets`` by
the prefix length, so it is broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import checked_broadcast

HEX_PREFIX = 3  # 4096 buckets per group


def hex_bucket(key_col: str, prefix: int = HEX_PREFIX) -> Column:
    """Bucket of a lower-case hex key: its first ``prefix`` characters (string
    order of hex digits equals numeric order)."""
    return F.substring(F.col(key_col), 1, prefix)


def quantile_bucket(df: DataFrame, part_cols, col: str, rows_per_bucket: int = 50_000, least: int = 16,
                    most: int = 1024) -> DataFrame:
    """Adds ``_bkt``: the bucket of ``col`` between quantiles of its own group,
    so an outlier or a group with ids of another scale leaves the buckets even.
    The bounds (groups x buckets numbers) are broadcast after a size check."""
    part_cols = list(part_cols)
    biggest = df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n = min(most, max(least, -(-biggest // rows_per_bucket)))
    bounds = df.groupBy(*part_cols).agg(F.percentile_approx(
        col, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(100 * n)).alias("_bounds"))
    joined = df.join(checked_broadcast(bounds), part_cols)
    below = F.size(F.filter("_bounds", lambda x: x < F.col(col)))
    return joined.withColumn("_bkt", F.when(F.col("_bounds").isNull(), 0).otherwise(below)).drop("_bounds")


def bucket_offsets(df: DataFrame, part_cols, bucket_col: str) -> DataFrame:
    """Rows before each (group, bucket): running sum of earlier bucket sizes."""
    counts = df.groupBy(*part_cols, bucket_col).agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy(*part_cols).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_bn").over(w), F.lit(0)).cast("bigint"))


def two_stage_rank(df: DataFrame, part_cols, order_cols, bucket: Column | None = None,
                   out: str = "rank") -> DataFrame:
    """Add ``out`` = 1-based rank of each row within ``part_cols`` by
    ``order_cols``.  ``bucket`` (or the column ``_bkt``) must be monotone in ``order_cols``."""
    part_cols = list(part_cols)
    b = df if bucket is None else df.withColumn("_bkt", bucket)
    offsets = bucket_offsets(b, part_cols, "_bkt").select(*part_cols, "_bkt", "_off")
    w = Window.partitionBy(*part_cols, "_bkt").orderBy(*order_cols)
    local = b.withColumn("_lrn", F.row_number().over(w))
    return (local.join(checked_broadcast(offsets), [*part_cols, "_bkt"])
            .withColumn(out, (F.col("_off") + F.col("_lrn")).cast("bigint"))
            .drop("_bkt", "_off", "_lrn"))


def in_ranges(df: DataFrame, keys) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions (split points are sampled, so ranges are even whatever the
    keys share) and stored, with ``_at``: the range in the upper bits, the place in it in the lower 33."""
    from .stages import materialize
    keys = list(keys)
    return materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))


def range_rank(df: DataFrame, part_cols, order_cols, out: str = "rank") -> DataFrame:
    """Add ``out`` = 1-based rank of each row within ``part_cols`` (not null) by ``order_cols``, which may mix directions and
    must be unique in a group.  ``df`` is read twice (for the sample, and sorted): give a stored one."""
    part_cols = list(part_cols)
    placed = in_ranges(df, [*part_cols, *order_cols]).withColumn("_rng", F.shiftright("_at", 33))
    runs = placed.groupBy(*part_cols, "_rng").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per group and range.
    earlier = Window.partitionBy(*part_cols).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (placed.join(checked_broadcast(runs), [*part_cols, "_rng"])
            .withColumn(out, (F.col("_off") + F.col("_at") - F.col("_first") + 1).cast("bigint"))
            .select(*df.columns, out))
