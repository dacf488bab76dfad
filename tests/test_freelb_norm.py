"""A FreeLB step takes the norm of a sequence once, not again for each of its numbers."""

import time

from pyspark.sql import functions as F

from braid.operators import heads as hd
from braid.operators import perturb as pt


def test_freelb_step_takes_its_norm_once(spark):
    """8 vectors of 2,000 dimensions: a norm for each number again would be 256,000,000 products a sequence."""
    dim = 2000
    model = hd.LinearModel([0, 1], [[1.0] * dim, [-1.0] * dim], [0.0, 0.0])
    df = spark.range(16).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.01), dim).alias("x"), (F.col("id") % 2).cast("int").alias("y_idx"))
    began = time.time()
    rows = pt.freelb(df, model, (1.0, 2, 0.5, 0.3)).select("delta_norm").collect()
    assert len(rows) == 2 and all(r[0] <= 0.3 + 1e-9 for r in rows) and time.time() - began < 20
