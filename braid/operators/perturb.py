"""Vector perturbations and robustness (J1-J7), on (vec, label) rows scored
by a small linear head (``heads.LinearModel``).

The gradient of cross entropy w.r.t. the input of a linear head is closed
form, ``g = sum_c (p_c - y_c) W_c``, so every step is a row-local expression.
Only global norms (FGM/PGD, over the whole table) are aggregates.  A PGD step is
one aggregate over the stored state and one write of the next state: with the
sums of g.g, r.g and r.r the norm of the moved delta needs no second pass.
FreeLB works per sequence (at most 8 member vectors, see
``heads.as_sequences``): members are gathered once and all steps run inside
the sequence row.

Fixed values: FGM epsilon 1; PGD epsilon 1, alpha 0.3, 3 steps; FreeLB
(init_mag, steps, lr, max_norm) per task from ``config.FREELB``; gradient
norm floor 1e-8.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FGM_EPSILON, FREELB, FREELB_NORM_FLOOR, PGD_ALPHA, PGD_EPSILON, PGD_K, SPLIT_SEED
from ..functions import arrays as ar
from ..plans.stages import materialize
from .heads import SEQ_LEN, LinearModel


def linear_grad(df: DataFrame, model: LinearModel, x: str = "x", y: str = "y_idx") -> DataFrame:
    """Per-row gradient ``g`` of the cross entropy w.r.t. ``x``."""
    return df.withColumn("g", model.grad(x, F.col(y)))


def table_norm(df: DataFrame, col: str) -> float:
    """Frobenius norm over the whole table (one partial aggregate)."""
    v = df.agg(F.sum(ar.sumsq(col)).alias("s")).first()["s"]
    return math.sqrt(v) if v is not None else float("nan")


def fgm(df: DataFrame, model: LinearModel, eps: float = FGM_EPSILON, keep=materialize) -> DataFrame:
    """``x + eps * g / ||G||_F`` (norm over the whole table); no-op when
    the norm is 0.  ``keep`` stores the gradients, so they are computed once."""
    g = keep(linear_grad(df, model))
    n = table_norm(g, "g")
    if n == 0 or math.isnan(n):
        return g.withColumn("x_adv", F.col("x")).drop("g")
    return g.withColumn("x_adv", ar.add("x", ar.scale("g", eps / n))).drop("g")


def project(delta_norm: float, eps: float) -> float:
    """Scale factor that brings a total delta into the eps ball."""
    return eps / delta_norm if delta_norm > eps else 1.0


def pgd(df: DataFrame, model: LinearModel, eps: float = PGD_EPSILON, alpha: float = PGD_ALPHA,
        k: int = PGD_K, keep=materialize) -> DataFrame:
    """``k`` ascent steps of size ``alpha`` along the normalised
    gradient, recomputed at each step; after every step the total delta is
    projected onto the Frobenius ball of radius ``eps``.  A step with a zero
    or NaN gradient norm is skipped (and with it all that would follow: the
    state they start from is the same).  ``keep`` stores the state of a step."""
    state = df.withColumn("_r", ar.scale("x", 0.0)).withColumn("_g", model.grad("x", F.col("y_idx")))
    for step in range(k):
        state = keep(state)
        gg, rg, rr = state.agg(F.sum(ar.sumsq("_g")), F.sum(ar.dot("_r", "_g")), F.sum(ar.sumsq("_r"))).first()
        if not gg or math.isnan(gg):
            break
        by = alpha / math.sqrt(gg)
        f = project(math.sqrt(max(0.0, rr + 2 * by * rg + alpha * alpha)), eps)
        state = state.withColumn("_r", F.zip_with("_r", "_g", lambda r, g: (r + g * F.lit(by)) * F.lit(f)))
        if step + 1 < k:
            state = state.withColumn("_g", model.grad(ar.add("x", "_r"), F.col("y_idx")))
    return state.withColumn("x_adv", ar.add("x", "_r")).drop("_r", "_g")


def uniform(*parts) -> Column:
    """Deterministic U(-1, 1) from md5 of the parts (engine independent)."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) * 2 - 1


def gather_sequences(df: DataFrame) -> DataFrame:
    """Members of each sequence (``vec_id div 8``), sorted by position, with their ``mask`` (1 real, 0 padding).

    What is padding comes from the data: a member without a vector or a label, with a null in the vector, or with fewer
    dimensions than the sequence's other vectors is kept as a position but takes no part; a missing position is none.  A column
    ``mask`` may name more.  Sequences without a real member have no row."""
    given = F.col("mask").cast("double") if "mask" in df.columns else F.lit(1.0)
    whole = F.col("x").isNotNull() & F.col("y_idx").isNotNull() & ~F.coalesce(F.exists("x", lambda v: v.isNull()), F.lit(True))
    s = df.select(F.floor(F.col("vec_id") / SEQ_LEN).cast("bigint").alias("seq_id"), "vec_id", "x", F.coalesce("y_idx", F.lit(0)).alias("y_idx"),
                  F.coalesce(given, F.lit(0.0)).alias("mask"), whole.alias("whole"))
    m = s.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y_idx", "mask", "whole"))).alias("m"),
                                F.max(F.when(F.col("whole"), F.size("x"))).alias("_dim"))
    real = lambda e: e["whole"] & (F.size(e["x"]) == F.col("_dim"))
    m = m.withColumn("m", F.transform("m", lambda e: F.struct(
        e["vec_id"].alias("vec_id"), F.when(real(e), e["x"]).otherwise(F.array_repeat(F.lit(0.0), F.col("_dim"))).alias("x"),
        e["y_idx"].alias("y_idx"), F.when(real(e), e["mask"]).otherwise(0.0).alias("mask"), real(e).alias("whole"))))
    return m.filter(F.exists("m", lambda e: e["mask"] > 0)).drop("_dim")


def freelb_init(seqs: DataFrame, init_mag: float, seed: int = SPLIT_SEED) -> DataFrame:
    """``delta = U(-1,1) * mask * init_mag / sqrt(len * dim)`` per member,
    ``len`` being the number of real members of the sequence."""
    dim = F.size(F.element_at("m", 1)["x"])
    mag = F.lit(init_mag) / F.sqrt(ar.total(F.col("m")["mask"]) * dim)
    # ``mag`` is named once: inside the functions of the elements it would be computed for each of them.
    return seqs.withColumn("d", ar.let(mag, lambda by: F.transform("m", lambda s: F.transform(
        F.sequence(F.lit(0), F.size(s["x"]) - 1), lambda j: uniform(s["vec_id"], j, seed) * by * s["mask"]))))


def _loss(model: LinearModel) -> Column:
    """Mean cross entropy of the real members at ``x + d``."""
    each = F.transform(F.arrays_zip("m", "d"), lambda z: -F.element_at(
        ar.log_softmax(model.logits(ar.add(z["m"]["x"], z["d"]))), z["m"]["y_idx"] + 1) * z["m"]["mask"])
    return ar.total(each) / ar.total(F.col("m")["mask"])


def _norm(vectors) -> Column:
    """Euclidean norm of an array of vectors taken as one."""
    v = F.col(vectors) if isinstance(vectors, str) else vectors
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + ar.sumsq(x)))


def _ascend(seqs: DataFrame, model: LinearModel, lr: float, radius: float) -> DataFrame:
    """One update of ``d``: by ``lr`` along the normalised gradient, then back
    onto the ball of ``radius`` (0: no ball)."""
    grad = F.transform(F.arrays_zip("m", "d"), lambda z: ar.scale(
        model.grad(ar.add(z["m"]["x"], z["d"]), z["m"]["y_idx"]), z["m"]["mask"]))
    by = F.lit(lr) / F.greatest(_norm("_g"), F.lit(FREELB_NORM_FLOOR))
    # The norm is named once: as a column used by the innermost function it was computed again for every number of a sequence.
    moved = seqs.withColumn("_g", grad).withColumn("d", ar.let(by, lambda b: F.zip_with(
        "d", "_g", lambda e, g: F.zip_with(e, g, lambda p, q: p + q * b))))
    if radius > 0:
        moved = moved.withColumn("d", ar.let(_norm("d"), lambda n: F.when(
            n > radius, F.transform("d", lambda e: F.transform(e, lambda p: p * radius / n))).otherwise(F.col("d"))))
    return moved.drop("_g")


def freelb(df: DataFrame, model: LinearModel, params=FREELB["quality"], seed: int = SPLIT_SEED,
           keep=materialize) -> DataFrame:
    """FreeLB on sequences.  With K steps, ``adv_loss`` is the mean of the
    losses at d_0 .. d_(K-1), where d_0 is the random start and each next
    delta is one ``_ascend`` from the last; ``d`` is d_(K-1).  ``keep`` stores
    the state after each update, so a lost executor resumes from there."""
    magnitude, steps, lr, radius = params
    state = freelb_init(gather_sequences(df), magnitude, seed).withColumn("adv_loss", _loss(model) / steps)
    for _ in range(steps - 1):
        state = keep(_ascend(state, model, lr, radius).withColumn("adv_loss", F.col("adv_loss") + _loss(model) / steps))
    return state.withColumn("delta_norm", _norm("d"))


def freelb_rows(seqs: DataFrame) -> DataFrame:
    """Back to one row per vector with ``x_adv = x + delta`` (a masked one is as it was; members without a whole vector have none)."""
    z = seqs.select("seq_id", F.explode(F.arrays_zip("m", "d")).alias("z")).filter("z.m.whole")
    return z.select(F.col("z.m.vec_id").alias("vec_id"), F.col("z.m.x").alias("x"),
                    F.col("z.m.y_idx").alias("y_idx"), ar.add(F.col("z.m.x"), F.col("z.d")).alias("x_adv"))


def report(scored: dict[str, DataFrame], model: LinearModel) -> DataFrame:
    """Loss, accuracy and macro-F1 of the head on each variant's
    ``x_adv`` (the clean variant has ``x_adv = x``).  All variants are scored
    in one union so a single aggregate (and one confusion table keyed by
    method) produces the report."""
    from . import metrics as mt
    parts = [df.select(F.lit(name).alias("task"), "y_idx", "x_adv") for name, df in scored.items()]
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    lg = (allv.withColumn("logits", model.logits("x_adv"))
          .select("task", F.col("y_idx").alias("label_idx"), ar.argmax("logits").alias("pred_idx"),
                  (-F.element_at(ar.log_softmax("logits"), F.col("y_idx") + 1)).alias("_nll")))
    base = lg.groupBy("task").agg(
        F.avg("_nll").alias("loss"),
        F.avg((F.col("pred_idx") == F.col("label_idx")).cast("double")).alias("accuracy"))
    return base.join(mt.macro_f1(lg), "task").withColumnRenamed("task", "method")
