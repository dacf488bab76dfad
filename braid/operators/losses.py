"""Loss tables over scored rows.

Input rows carry ``logits ARRAY<DOUBLE>`` and ``label_idx INT``.  Per-row
terms are column expressions; reductions are (partial) aggregates grouped by
the caller's keys -- never a collect.

Fixed values (must equal the reference for equal results):
  focal gamma 2, pt epsilon 1e-10, alpha list normalised to sum 1,
  scalar alpha -> alpha at ``balance_index`` and 1 - alpha elsewhere;
  dice smoothing 1 in ``2 * (x*y + 1) / (x + y + 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FOCAL_EPS, FOCAL_GAMMA
from ..functions import arrays as ar
from .common import checked_broadcast


def nll(logits="logits", y="label_idx") -> Column:
    """Per-row cross entropy ``-log_softmax(logits)[y]``."""
    return -F.element_at(ar.log_softmax(logits), F.col(y) + 1)


def cross_entropy(df: DataFrame, keys=("task",), weights: DataFrame | None = None) -> DataFrame:
    """Mean NLL per group; with ``weights(task, label_idx, weight)``
    the weighted form ``sum(w_y * nll) / sum(w_y)``."""
    keys = list(keys)
    d = df.withColumn("_nll", nll())
    if weights is None:
        return d.groupBy(*keys).agg(F.avg("_nll").alias("loss"), F.count(F.lit(1)).alias("n"))
    d = d.join(checked_broadcast(weights.select("task", "label_idx", "weight")), ["task", "label_idx"], "left")
    return d.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("_nll")) / F.sum("weight")).alias("loss"),
                                F.count(F.lit(1)).alias("n"))


def alpha_table(weights: DataFrame, alpha="list", balance_index: int = -1) -> DataFrame:
    """Focal alpha per (task, label_idx).

    ``alpha='list'``: the task's class weights normalised to sum 1;
    ``alpha=None``: 1 for every class; a float ``a``: ``a`` at
    ``balance_index`` (Python-style, -1 = last class) and ``1 - a`` elsewhere.
    """
    if alpha == "list":
        return weights.select("task", "label_idx",
                              (F.col("weight") / F.sum("weight").over(Window.partitionBy("task"))).alias("alpha"))
    if alpha is None:
        return weights.select("task", "label_idx", F.lit(1.0).alias("alpha"))
    if isinstance(alpha, float):
        nc = F.count(F.lit(1)).over(Window.partitionBy("task"))
        target = F.when(F.lit(balance_index) < 0, nc + balance_index).otherwise(F.lit(balance_index))
        return weights.select("task", "label_idx", F.when(F.col("label_idx") == target, alpha)
                              .otherwise(1.0 - alpha).alias("alpha"))
    raise TypeError("alpha must be 'list', None or a float")


def focal_terms(df: DataFrame, gamma: float = FOCAL_GAMMA, smooth: float | None = None) -> DataFrame:
    """D15/D16 per-row focal term ``(1 - pt)^gamma * (-ln pt)`` with
    ``pt = sum(onehot * softmax) + 1e-10``; ``smooth`` clamps the one-hot to
    ``[smooth, 1 - smooth]``."""
    if smooth is not None and not (0.0 <= smooth <= 1.0):
        raise ValueError(f"smooth must lie between 0 and 1, not {smooth}")
    p = ar.softmax("logits")
    oh = ar.one_hot(F.col("label_idx"), F.size("logits"))
    if smooth:
        oh = F.transform(oh, lambda v: F.least(F.greatest(v, F.lit(smooth)), F.lit(1.0 - smooth)))
    pt = ar.dot(oh, p) + F.lit(FOCAL_EPS)
    return df.withColumn("_pt", pt).withColumn(
        "_focal", F.pow(1 - F.col("_pt"), F.lit(gamma)) * (-F.log("_pt")))


def focal(df: DataFrame, alpha: DataFrame, keys=("task",), gamma: float = FOCAL_GAMMA,
          smooth: float | None = None, reduce: str = "mean", mode: str = "paired") -> DataFrame:
    """Focal loss per group.

    ``mode='paired'``: each row's term times its own class alpha.
    ``mode='broadcast'``: the (N,1) x (N,) broadcast of the original tensors:
    mean = mean(alpha_i) * mean(term_j), sum = sum(alpha_i) * sum(term_j).
    """
    if reduce not in ("mean", "sum") or mode not in ("paired", "broadcast"):
        raise ValueError("reduce in {mean,sum}, mode in {paired,broadcast}")
    keys = list(keys)
    d = focal_terms(df, gamma, smooth).join(checked_broadcast(alpha), ["task", "label_idx"], "left")
    agg = F.avg if reduce == "mean" else F.sum
    if mode == "paired":
        return d.groupBy(*keys).agg(agg(F.col("alpha") * F.col("_focal")).alias("loss"))
    return d.groupBy(*keys).agg((agg("alpha") * agg("_focal")).alias("loss"))


def dice_per_class(df: DataFrame, keys=("task",), mode: str = "probs") -> DataFrame:
    """Per class ``1 - mean_n 2(x*y + 1)/(x + y + 1)`` with x the
    class probability (``probs``) or the raw logit (``raw``), y the one-hot."""
    if mode not in ("probs", "raw"):
        raise ValueError("mode must be probs or raw")
    keys = list(keys)
    x = ar.softmax("logits") if mode == "probs" else F.col("logits")
    oh = ar.one_hot(F.col("label_idx"), F.size("logits"))
    long = df.select(*keys, F.posexplode(F.arrays_zip(x.alias("x"), oh.alias("y"))).alias("class_idx", "xy"))
    term = 2 * (F.col("xy.x") * F.col("xy.y") + 1) / (F.col("xy.x") + F.col("xy.y") + 1)
    return long.groupBy(*keys, "class_idx").agg((1 - F.avg(term)).alias("dice"))


def dice(df: DataFrame, keys=("task",), mode: str = "probs", weights: DataFrame | None = None) -> DataFrame:
    """Sum over classes of D17, optionally times class weights
    ``weights(task, label_idx, weight)``."""
    keys = list(keys)
    per = dice_per_class(df, keys, mode)
    if weights is not None:
        w = checked_broadcast(weights.select("task", F.col("label_idx").alias("class_idx"), "weight"))
        per = per.join(w, ["task", "class_idx"], "left").withColumn("dice", F.col("dice") * F.col("weight"))
    return per.groupBy(*keys).agg(F.sum("dice").alias("loss"))


def batch_mean(df: DataFrame, keys=("task",)) -> DataFrame:
    """Mean of per-batch mean NLL (the last partial batch weighs as much
    as a full one), next to the row-weighted mean."""
    keys = list(keys)
    per = (df.withColumn("_nll", nll()).groupBy(*keys, "batch_id")
           .agg(F.avg("_nll").alias("bl"), F.sum("_nll").alias("bs"), F.count(F.lit(1)).alias("bn")))
    return per.groupBy(*keys).agg(F.avg("bl").alias("batch_mean"),
                                  (F.sum("bs") / F.sum("bn")).alias("row_mean"),
                                  F.count(F.lit(1)).alias("n_batches"))


LOSSES = ("cross_entropy", "focal_loss", "dice_loss")


def compute(df: DataFrame, name: str, keys=("task",), weights: DataFrame | None = None, **kw) -> DataFrame:
    """Loss by name.  ``focal_loss`` needs class weights (its alpha)."""
    if name == "cross_entropy":
        return cross_entropy(df, keys, weights)
    if name == "focal_loss":
        if weights is None:
            raise ValueError("focal_loss needs class weights")
        return focal(df, alpha_table(weights), keys, **kw)
    if name == "dice_loss":
        return dice(df, keys, kw.get("mode", "raw"))
    raise ValueError(f"unknown loss {name!r}")
