"""Training-log monitors.

Inputs are step-level tables:
  ``step_preds(run_id, epoch, step, task, label_idx, pred_idx)`` -- one row
  per example seen at a step;
  ``step_log(run_id, epoch, step, task, loss, acc)`` -- one row per step/task;
  ``eval_log(run_id, epoch, step, train_loss, train_f1, dev_loss, dev_f1, ...)``
  -- one row per evaluation, with both F1 of every task.
Running metrics are cumulative sums over a dense (class x evaluation period)
grid built with ``sequence`` (no join of all pairs).  What runs over the steps or evaluation periods
of a log goes block by block (``scan``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVAL_EVERY, PATIENCE_STEPS
from . import scan
from .common import checked_broadcast


def running_f1(step_preds: DataFrame, eval_every: int = EVAL_EVERY, block: int = scan.BLOCK) -> DataFrame:
    """E5: macro-F1 per task over all rows seen in the epoch up to each
    evaluation step (steps that are multiples of ``eval_every``)."""
    cells = (step_preds.groupBy("run_id", "epoch", "task", F.ceil(F.col("step") / eval_every).cast("int").alias("period"),
                                "label_idx", "pred_idx").agg(F.count(F.lit(1)).alias("n")))
    ev = cells.select("run_id", "epoch", "task", "period", F.explode(F.array(
        F.struct(F.col("label_idx").alias("cls"), F.col("n").alias("t"), F.lit(0).alias("p"),
                 F.when(F.col("label_idx") == F.col("pred_idx"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred_idx").alias("cls"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")),
    )).alias("e"))
    agg = ev.groupBy("run_id", "epoch", "task", F.col("e.cls").alias("cls"), "period").agg(
        F.sum("e.t").alias("t"), F.sum("e.p").alias("p"), F.sum("e.tp").alias("tp"))
    n_per = (step_preds.groupBy("run_id", "epoch").agg(F.max("step").alias("_ms"))
             .withColumn("n_periods", F.floor(F.col("_ms") / eval_every).cast("int")).drop("_ms"))
    grid = (agg.select("run_id", "epoch", "task", "cls").distinct().join(checked_broadcast(n_per), ["run_id", "epoch"])
            .filter(F.col("n_periods") >= 1)
            .select("run_id", "epoch", "task", "cls", F.explode(F.sequence(F.lit(1), F.col("n_periods"))).alias("period")))
    g = grid.join(agg, ["run_id", "epoch", "task", "cls", "period"], "left").fillna(0, ["t", "p", "tp"])
    last = step_preds.agg(F.max("step")).first()[0] or 0
    g = scan.running(g, ["run_id", "epoch", "task", "cls"], "period",
                     {"ct": ("sum", "t"), "cp": ("sum", "p"), "ctp": ("sum", "tp")}, last // eval_every, block)
    seen = g.filter(F.col("ct") + F.col("cp") > 0)
    return (seen.groupBy("run_id", "epoch", "task", "period")
            .agg(F.avg(2 * F.col("ctp") / (F.col("ct") + F.col("cp"))).alias("f1"))
            .select("run_id", "epoch", (F.col("period") * eval_every).cast("bigint").alias("step"), "task", "f1"))


def running_loss(step_log: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """``total_loss / step`` -- running mean of the per-step summed loss
    within an epoch, block by block (``scan``)."""
    largest = step_log.agg(F.max("step")).first()[0] or 0
    tot = step_log.groupBy("run_id", "epoch", "step").agg(F.sum("loss").alias("total"))
    tot = tot.withColumn("_one", F.when(F.col("total").isNotNull(), 1).otherwise(0).cast("bigint"))
    run = scan.running(tot, ["run_id", "epoch"], "step", {"_sum": ("sum", "total"), "_n": ("sum", "_one")}, largest, block)
    return run.select("run_id", "epoch", "step", "total", F.try_divide("_sum", "_n").alias("running_loss"))


def eval_log(step_log: DataFrame, step_preds: DataFrame, dev: DataFrame, tasks,
             eval_every: int = EVAL_EVERY) -> DataFrame:
    """Evaluation rows: running train loss, train and dev macro-F1 (mean of the
    tasks, and ``<task>_train_f1`` / ``<task>_dev_f1``) and dev loss.

    ``dev(run_id, epoch, step, task, loss, f1)``: the dev split under the model
    as it stands at the evaluation."""
    def of_tasks(df, kind, *more):
        return df.groupBy("run_id", "epoch", "step").agg(
            F.avg("f1").alias(f"{kind}_f1"), *more,
            *[F.max(F.when(F.col("task") == t, F.col("f1"))).alias(f"{t}_{kind}_f1") for t in tasks])
    key = ["run_id", "epoch", "step"]
    rl = running_loss(step_log).select(*key, F.col("running_loss").alias("train_loss"))
    return (of_tasks(running_f1(step_preds, eval_every), "train").join(rl, key, "left")
            .join(of_tasks(dev, "dev", F.avg("loss").alias("dev_loss")), key, "left"))


def best_so_far(ev: DataFrame, start: float = 0.0, metric: str = "dev_f1") -> DataFrame:
    """Strict improvement over the best earlier evaluation of the run
    (start value 0) in the dev F1; ``flag`` is '*' on improvement, ' ' otherwise."""
    w = Window.partitionBy("run_id").orderBy("epoch", "step").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.max(metric).over(w), F.lit(start))
    d = ev.withColumn("prev_best", F.greatest(prev, F.lit(start)))
    return (d.withColumn("improved", F.col(metric) > F.col("prev_best"))
            .withColumn("best_f1", F.greatest("prev_best", metric))
            .withColumn("flag", F.when(F.col("improved"), "*").otherwise(" ")))


def early_stop(best: DataFrame, steps_per_epoch: DataFrame, patience: int = PATIENCE_STEPS) -> DataFrame:
    """First global step whose steps-since-improvement counter exceeds
    ``patience`` (the counter resets at an improvement and grows by one every
    step, across epochs).  Empty when training ends first.

    ``steps_per_epoch(run_id, spe, n_epochs)``.
    """
    spe = checked_broadcast(steps_per_epoch)
    imp = (best.filter("improved").join(spe, "run_id")
           .select("run_id", ((F.col("epoch") - 1) * F.col("spe") + F.col("step")).alias("g")))
    start = steps_per_epoch.select("run_id", F.lit(0).cast("bigint").alias("g"))
    c = imp.unionByName(start)
    w = Window.partitionBy("run_id").orderBy("g")
    c = (c.withColumn("next_g", F.lead("g").over(w))
         .withColumn("cand", F.when(F.col("g") == 0, F.lit(patience + 1)).otherwise(F.col("g") + patience)))
    c = c.join(spe, "run_id").filter(
        (F.col("next_g").isNull() | (F.col("next_g") > F.col("cand"))) & (F.col("cand") <= F.col("spe") * F.col("n_epochs")))
    first = c.groupBy("run_id").agg(F.min_by(F.struct("cand", "g"), "cand").alias("s"))
    return first.join(spe, "run_id").select(
        "run_id",
        ((F.col("s.cand") - 1) / F.col("spe")).cast("bigint").alias("_e0"),
        F.col("s.cand").cast("bigint").alias("global_step"),
        F.col("s.g").cast("bigint").alias("last_improved"), "spe",
    ).select("run_id", (F.col("_e0") + 1).alias("stop_epoch"),
             (F.col("global_step") - F.col("_e0") * F.col("spe")).cast("bigint").alias("stop_step"),
             "global_step", "last_improved")


def resume_point(step_log: DataFrame) -> DataFrame:
    """Last completed epoch, the epoch to resume at (``next_epoch``), and
    the epoch a resume restarts at when the finished epoch number is stored
    instead of the next one."""
    per = step_log.groupBy("run_id", "epoch").agg(F.countDistinct("step").alias("n_steps"))
    full = per.withColumn("_mx", F.max("n_steps").over(Window.partitionBy("run_id"))) \
              .filter(F.col("n_steps") == F.col("_mx"))
    return full.groupBy("run_id").agg(F.max("epoch").cast("bigint").alias("last_epoch")).select(
        "run_id", "last_epoch", (F.col("last_epoch") + 1).alias("next_epoch"),
        F.col("last_epoch").alias("restart_epoch_as_stored"))


def format_progress(best: DataFrame, tasks) -> DataFrame:
    """One progress line per evaluation; the fields, their names and order are a fixed output format."""
    pct = "%.2f%%"
    per = lambda kind: ", ".join(f"{t}_{kind}_f1:{pct}" for t in tasks)
    line = (f"ITER:%d, TRAIN_LOSS:%.3f, TRAIN_F1:{pct}, {per('train')}, "
            f"DEV_LOSS:%.3f, DEV_F1:{pct}, {per('dev')}%s")
    hundred = lambda c: F.col(c) * 100
    return best.select("run_id", "epoch", "step", F.format_string(
        line, F.col("step"), F.col("train_loss"), hundred("train_f1"), *[hundred(f"{t}_train_f1") for t in tasks],
        F.col("dev_loss"), hundred("dev_f1"), *[hundred(f"{t}_dev_f1") for t in tasks], F.col("flag")).alias("line"))


def append_log(lines: DataFrame, path: str) -> None:
    """Appends progress lines to the log table at ``path``.  An evaluation has a folder of its own, so one that is
    written again replaces itself and no line doubles."""
    (lines.select("run_id", "epoch", "step", "line").repartition("run_id", "epoch", "step").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "epoch", "step").parquet(path))


def read_log(spark, path: str) -> DataFrame:
    """The log table of ``append_log``."""
    return spark.read.schema("line string, run_id string, epoch bigint, step bigint").parquet(path).select("run_id", "epoch", "step", "line")
