"""Multi-task loss weighting over ``step_log(run_id, epoch, step, task,
loss, acc)`` (I1-I4, E4, D20).

All operators work on the per-step log (one row per step and task), never on
example rows.  Windows are partitioned by (run_id, epoch, step), of which a step has
one row per task; lags over a run go block by block (``scan``).

Fixed values: DWA temperature 2; DTP gamma 0.5 with the accuracy clamped to
[0.1, 0.99]; uncertainty weights start at s = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DTP_GAMMA, DTP_KPI_MAX, DTP_KPI_MIN, DWA_T
from . import scan

STRATEGIES = ("none", "dwa", "dtp", "uw")


def plain_sum(log: DataFrame) -> DataFrame:
    """Sum of task losses per step."""
    return log.groupBy("run_id", "epoch", "step").agg(F.sum("loss").alias("total"))


def dwa(log: DataFrame, T: float = DWA_T, mode: str = "paper", block: int = scan.BLOCK) -> DataFrame:
    """``w_t = K * softmax_t(r_t / T)``.

    A ratio with a zero denominator is undefined; a step with any undefined
    ratio keeps the weights at 1.

    ``paper``: r = L(s-1) / L(s-2) over the global step order; weights 1
    until two earlier losses exist.  ``current``: r = L(s) / L(s-1).
    ``reference``: the loss list is never reset while the step counter
    restarts every epoch, so step s reads the list at s and s-1 -- the first
    epoch's losses; at step 1 the previous step's weights persist (1 in the
    first epoch).
    """
    if mode not in ("paper", "current", "reference"):
        raise ValueError("mode must be paper, current or reference")
    key, ends = ["run_id", "task"], log.agg(F.max("epoch"), F.max("step")).first()
    ends = tuple(x or 0 for x in ends)
    if mode in ("paper", "current"):
        d = scan.place(log, key, "epoch", "step", "_g", ends, block)
        back = 2 if mode == "paper" else 1
        d = scan.lagged(d, key, "_g", {"_l1": ("loss", 1), "_l2": ("loss", back)}, block)
        r = F.try_divide("_l1", "_l2") if mode == "paper" else F.try_divide("loss", "_l1")
        d = d.withColumn("_r", r).drop("_g", "_l1", "_l2")
    else:
        first = log.filter(F.col("epoch") == F.lit(1)).select("run_id", "task", "epoch", "step", F.col("loss").alias("_l1"))
        first = scan.lagged(scan.place(first, key, "epoch", "step", "_g", (1, ends[1]), block), key, "_g", {"_l0": ("_l1", 1)}, block)
        first = first.select("run_id", "task", "step", F.try_divide("_l1", "_l0").alias("_r1"))
        last = first.groupBy("run_id", "task").agg(F.max_by("_r1", "step").alias("_rlast"))
        d = (log.join(first, ["run_id", "task", "step"], "left")
             .join(last, ["run_id", "task"], "left")
             .withColumn("_r", F.when(F.col("step") >= 2, F.col("_r1"))
                         .when(F.col("epoch") >= 2, F.col("_rlast"))))
    w_step = Window.partitionBy("run_id", "epoch", "step")
    k = F.count(F.lit(1)).over(w_step)
    e = F.exp(F.col("_r") / T)
    all_r = F.min(F.col("_r").isNotNull().cast("int")).over(w_step) == 1
    weight = F.when(all_r, k * e / F.sum(e).over(w_step)).otherwise(F.lit(1.0))
    return d.withColumn("weight", weight).drop("_r", "_r1", "_rlast")


def dtp_weight(acc: Column, gamma: float = DTP_GAMMA) -> Column:
    """``-(1 - k)^gamma * ln k`` with k = accuracy clamped to [0.1, 0.99]."""
    k = F.least(F.greatest(acc, F.lit(DTP_KPI_MIN)), F.lit(DTP_KPI_MAX))
    return -F.pow(1 - k, F.lit(gamma)) * F.log(k)


def dtp(log: DataFrame, gamma: float = DTP_GAMMA) -> DataFrame:
    return log.withColumn("weight", dtp_weight(F.col("acc"), gamma))


def uw(log: DataFrame, s: DataFrame | None = None, closed_form: bool = False) -> DataFrame:
    """Per task ``exp(-s_t) * L_t + s_t``; ``s`` defaults to 0 (initial
    state) or, with ``closed_form``, to its per-step minimiser ``ln L_t``
    (undefined, hence null, for a zero loss)."""
    if closed_form:
        d = log.withColumn("_s", F.when(F.col("loss") > 0, F.log("loss")))
    elif s is not None:
        d = log.join(F.broadcast(s.select("task", F.col("s").alias("_s"))), "task", "left") \
               .withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    else:
        d = log.withColumn("_s", F.lit(0.0))
    return d.withColumn("weight", F.exp(-F.col("_s"))).withColumn(
        "term", F.exp(-F.col("_s")) * F.col("loss") + F.col("_s")).drop("_s")


def total_loss(log: DataFrame, strategy: str = "none", use_pcgrad: bool = False, **kw) -> DataFrame:
    """I4: combined loss per step for a named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown loss strategy {strategy!r}")
    if use_pcgrad and strategy != "none":
        raise ValueError(f"loss strategy {strategy!r} is incompatible with gradient surgery")
    if strategy == "none":
        return plain_sum(log)
    if strategy == "uw":
        return uw(log, **kw).groupBy("run_id", "epoch", "step").agg(F.sum("term").alias("total"))
    w = dwa(log, **kw) if strategy == "dwa" else dtp(log, **kw)
    return w.groupBy("run_id", "epoch", "step").agg(F.sum(F.col("weight") * F.col("loss")).alias("total"))
