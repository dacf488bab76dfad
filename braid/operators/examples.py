"""Unified example table, label dictionary and label encoding.

Join policy used throughout the package: tables whose size is bounded by the
configuration (one row per task, per bucket, ...) are hinted with
``F.broadcast``.  Tables derived from the data (label dictionaries, weights,
vocabularies) are joined without a hint; AQE measures the materialised side at
run time and switches to a broadcast join only when it is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``, falling back to a shuffle
join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TASKS
from ..sources import tables


def task_dim(spark: SparkSession) -> DataFrame:
    """One row per configured task (bounded by configuration)."""
    rows = [(t.name, t.idx, t.kind, t.max_length, t.max_a, t.max_b) for t in TASKS]
    return spark.createDataFrame(
        rows, "task string, task_idx int, kind string, max_length int, max_a int, max_b int")


def to_examples(df: DataFrame, task: str, kind: str) -> DataFrame:
    """B2: project any source to the example schema, filling missing columns."""
    out = df.withColumn("task", F.lit(task))
    for c in ("text_b", "label"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*tables.EXAMPLE_COLUMNS).withColumn("kind", F.lit(kind))


def load_examples(spark: SparkSession, sf_dir: str, tasks=None) -> DataFrame:
    """All tasks' labelled and test rows in one long table.

    Columns: task, id, text_a, text_b, label, kind ('labelled' | 'test').
    """
    names = [t.name for t in TASKS] if tasks is None else list(tasks)
    parts = []
    for name in names:
        parts.append(to_examples(tables.LABELLED[name](spark, sf_dir), name, "labelled"))
        parts.append(to_examples(tables.TEST[name](spark, sf_dir), name, "test"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def labelled(examples: DataFrame) -> DataFrame:
    """Rows that carry a label."""
    return examples.filter((F.col("kind") == "labelled") & F.col("label").isNotNull())


def build_label_dim(examples: DataFrame) -> DataFrame:
    """Distinct labels per task, indexed in label order (0-based).

    The distinct runs as a partial (map-side) aggregate, so only one row per
    (task, label) and partition reaches the shuffle.
    """
    d = labelled(examples).select("task", "label").distinct()
    w = Window.partitionBy("task").orderBy("label")
    return d.withColumn("label_idx", (F.row_number().over(w) - 1).cast("int"))


def encode_labels(examples: DataFrame, label_dim: DataFrame, unknown: str = "error") -> DataFrame:
    """Add ``label_idx``.

    ``unknown`` decides what happens to a label missing from ``label_dim``:
    ``error`` fails the query (``raise_error`` evaluated per row, JVM side),
    ``null`` keeps the row unlabelled (idx null), ``drop`` removes it.
    """
    if unknown not in ("null", "drop", "error"):
        raise ValueError("unknown must be null, drop or error")
    out = examples.join(label_dim, ["task", "label"], "left")
    if unknown == "drop":
        out = out.filter(F.col("label").isNull() | F.col("label_idx").isNotNull())
    elif unknown == "error":
        out = out.withColumn(
            "label_idx",
            F.when(F.col("label").isNotNull() & F.col("label_idx").isNull(),
                   F.raise_error(F.concat(F.lit("unknown label "), F.col("label"))).cast("int"))
            .otherwise(F.col("label_idx")),
        )
    return out


def get_split(df: DataFrame, split: str) -> DataFrame:
    """All tasks' rows of one split (a partition filter when the table is
    written partitioned by task/split)."""
    return df.filter(F.col("split") == split)


def head_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    """A4: first ``n`` rows of every group in a deterministic order.

    This is the debug-mode row cap, i.e. the limit *is* the feature.  A
    per-group top-n window is evaluated with Spark's window group limit
    (partial top-n before the shuffle), so at most n rows per group and
    partition are exchanged.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
