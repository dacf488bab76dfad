"""Robustness stage: the centroid head on the ``embeddings`` table and its
FGM / PGD / FreeLB perturbations (J1-J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import perturb as pt
from ..operators.common import r6
from .vectors import centroid_model, vecs


class Robust:
    def __init__(self, spark, sf_dir):
        v = vecs(spark, sf_dir)
        self.model = centroid_model(v)
        from .stages import materialize, spread
        rows = v.select("vec_id", F.col("embedding").alias("x"), self.model.label_index("label").alias("y_idx"))
        self.rows = materialize(spread(rows, v.select("vec_id")))

    @classmethod
    def get(cls, spark, sf_dir) -> Robust:
        from .stages import stage
        return stage(spark, sf_dir, "robust", lambda: cls(spark, sf_dir))


def _long(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(col).alias("dim", name)).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), r6(name).alias(name))


def linear_grad(spark, sf_dir):
    r = Robust.get(spark, sf_dir)
    return _long(pt.linear_grad(r.rows, r.model), "g", "g")


def fgm(spark, sf_dir):
    r = Robust.get(spark, sf_dir)
    return _long(pt.fgm(r.rows, r.model), "x_adv", "x_adv")


def pgd(spark, sf_dir):
    r = Robust.get(spark, sf_dir)
    return _long(pt.pgd(r.rows, r.model), "x_adv", "x_adv")


def freelb_init(spark, sf_dir):
    from ..config import FREELB
    r = Robust.get(spark, sf_dir)
    s = pt.freelb_init(pt.gather_sequences(r.rows), FREELB["quality"][0])
    z = s.select(F.explode(F.arrays_zip("m", "d")).alias("z"))
    return _long(z.select(F.col("z.m.vec_id").alias("vec_id"), F.col("z.d").alias("d")), "d", "delta")


def freelb(spark, sf_dir):
    """All presets, over every vector; padding is what the data lack."""
    from ..config import FREELB
    r = Robust.get(spark, sf_dir)
    parts = [pt.freelb(r.rows, r.model, params).select(
        F.lit(name).alias("preset"), "seq_id", r6("delta_norm").alias("delta_norm"), r6("adv_loss").alias("adv_loss"))
        for name, params in FREELB.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def robustness(spark, sf_dir):
    r = Robust.get(spark, sf_dir)
    variants = {
        "clean": r.rows.withColumn("x_adv", F.col("x")),
        "fgm": pt.fgm(r.rows, r.model),
        "pgd": pt.pgd(r.rows, r.model),
        "freelb": pt.freelb_rows(pt.freelb(r.rows, r.model)),
    }
    rep = pt.report(variants, r.model)
    return rep.select("method", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"),
                      r6("macro_f1").alias("macro_f1"))
