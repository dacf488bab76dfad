"""Confusion, accuracy, per-class and macro F1, label decoding and the
JSON-lines submission (D8-D11, B4, C5, A7, G16).

F1 follows the usual macro definition: the class set is every class seen in
truth or prediction; precision/recall/F1 are 0 where undefined.  Everything
is computed from the confusion aggregate (at most tasks x classes^2 rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast


def confusion(preds: DataFrame, keys=("task",)) -> DataFrame:
    """Rows per (keys, label_idx, pred_idx); truth and prediction are
    columns of the same row."""
    return (preds.filter(F.col("label_idx").isNotNull())
            .groupBy(*keys, "label_idx", "pred_idx").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def accuracy(preds: DataFrame, keys=("task",)) -> DataFrame:
    """Share of rows with ``pred_idx == label_idx``."""
    return (preds.filter(F.col("label_idx").isNotNull()).groupBy(*keys)
            .agg(F.avg((F.col("pred_idx") == F.col("label_idx")).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).cast("bigint").alias("n")))


def per_class(conf: DataFrame, keys=("task",)) -> DataFrame:
    """Tp / predicted / true counts and P, R, F1 per class."""
    keys = list(keys)
    t = conf.groupBy(*keys, F.col("label_idx").alias("class_idx")).agg(
        F.sum("n").alias("n_true"), F.sum(F.when(F.col("label_idx") == F.col("pred_idx"), F.col("n"))
                                          .otherwise(0)).alias("tp"))
    p = conf.groupBy(*keys, F.col("pred_idx").alias("class_idx")).agg(F.sum("n").alias("n_pred"))
    c = t.join(p, [*keys, "class_idx"], "full")
    tp = F.coalesce("tp", F.lit(0))
    nt = F.coalesce("n_true", F.lit(0))
    npred = F.coalesce("n_pred", F.lit(0))
    prec = F.when(npred > 0, tp / npred).otherwise(0.0)
    rec = F.when(nt > 0, tp / nt).otherwise(0.0)
    f1 = F.when(nt + npred > 0, 2 * tp / (nt + npred)).otherwise(0.0)
    return c.select(*keys, "class_idx", tp.cast("bigint").alias("tp"), npred.cast("bigint").alias("n_pred"),
                    nt.cast("bigint").alias("n_true"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"))


def macro_f1(preds: DataFrame, keys=("task",)) -> DataFrame:
    """Unweighted mean of per-class F1 over classes seen in truth or
    prediction."""
    keys = list(keys)
    return per_class(confusion(preds, keys), keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def evaluate(preds: DataFrame, task_loss: DataFrame | None = None, keys=()) -> DataFrame:
    """Mean over tasks of the task macro-F1 (and of the task loss when
    ``task_loss(task, loss)`` is given)."""
    keys = list(keys)
    m = macro_f1(preds, [*keys, "task"])
    if task_loss is not None:
        m = m.join(task_loss.select(*keys, "task", "loss"), [*keys, "task"], "left")
        return m.groupBy(*keys).agg(F.avg("macro_f1").alias("f1"), F.avg("loss").alias("loss"),
                                    F.count(F.lit(1)).cast("bigint").alias("n_tasks"))
    return m.groupBy(*keys).agg(F.avg("macro_f1").alias("f1"), F.count(F.lit(1)).cast("bigint").alias("n_tasks"))


def decode_labels(preds: DataFrame, label_dim: DataFrame) -> DataFrame:
    """``pred_idx`` -> label string via the label dictionary."""
    d = checked_broadcast(label_dim.select("task", F.col("label_idx").alias("pred_idx"),
                                           F.col("label").alias("pred_label")))
    return preds.join(d, ["task", "pred_idx"], "left")


def submission_lines(decoded: DataFrame, id_col: str = "id") -> DataFrame:
    """One JSON object per row, ``{"id":<n>,"label":"<s>"}``, properly
    escaped by ``to_json``."""
    return decoded.select("task", id_col, F.to_json(F.struct(F.col(id_col).alias("id"),
                                                             F.col("pred_label").alias("label"))).alias("line"))


def write_submission(lines: DataFrame, out_dir: str) -> None:
    """A7 sink: one JSON-lines file set per task (``task=<name>/part-*``)."""
    lines.select("task", "line").write.mode("overwrite").partitionBy("task").text(out_dir)
