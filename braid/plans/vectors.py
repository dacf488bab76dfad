"""Vector-table stage: array kit, pooling heads and the centroid linear head
over the ``embeddings`` table (the ``vec`` task)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import heads as hd
from ..operators.common import r6
from ..sources import tables


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.embeddings(spark, sf_dir)


def centroid_model(v: DataFrame) -> hd.LinearModel:
    return hd.LinearModel.from_centroids(hd.fit_centroids(v))


def mean_vector(v: DataFrame) -> list[float]:
    """Global mean vector (one partial aggregate of whole vectors) used as attention query."""
    row = v.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding")))).alias("m")).first()
    return row["m"] or []


def long_vec(df: DataFrame, id_col: str, col: str = "pooled", name: str = "v") -> DataFrame:
    return df.select(id_col, F.posexplode(col).alias("dim", name)).select(
        id_col, F.col("dim").cast("bigint").alias("dim"), r6(name).alias(name))


def array_kit(spark, sf_dir):
    v = vecs(spark, sf_dir)
    classes = (v.agg(F.max("label")).first()[0] or 0) + 1
    mask = F.transform("embedding", lambda x: F.when(x != 0, 1).otherwise(0))
    return v.select(
        "vec_id",
        ar.argmax("embedding").cast("bigint").alias("argmax"),
        r6(ar.l2("embedding")).alias("norm"),
        ar.masked_len(mask).cast("bigint").alias("n_nonzero"),
        r6(F.array_max(ar.softmax("embedding"))).alias("max_softmax"),
        r6(F.element_at(ar.normalize("embedding"), 1)).alias("unit_x0"),
        (F.array_position(ar.one_hot("label", classes), 1.0) - 1).cast("bigint").alias("onehot_pos"),
    )


def centroids(spark, sf_dir):
    c = hd.fit_centroids(vecs(spark, sf_dir))
    return c.select(F.col("label").cast("bigint").alias("label"), F.posexplode("centroid").alias("dim", "c"),
                    "bias").select("label", F.col("dim").cast("bigint").alias("dim"), r6("c").alias("c"),
                                   r6("bias").alias("bias"))


def linear_scores(spark, sf_dir):
    v = vecs(spark, sf_dir)
    m = centroid_model(v)
    s = hd.linear_score(v, m)
    return s.select("vec_id", F.posexplode("logits").alias("class_idx", "logit")).select(
        "vec_id", F.col("class_idx").cast("bigint").alias("class_idx"), r6("logit").alias("logit"))


def linear_scores_join(spark, sf_dir):
    """H9 by the block join that scores models too large to fetch."""
    v = vecs(spark, sf_dir)
    s = hd.join_scores(v, hd.fit_centroids(v), block=4)
    return s.select("vec_id", F.posexplode("logits").alias("class_idx", "logit")).select(
        "vec_id", F.col("class_idx").cast("bigint").alias("class_idx"), r6("logit").alias("logit"))


def _seqs(spark, sf_dir):
    return hd.as_sequences(vecs(spark, sf_dir))


def pool_first(spark, sf_dir):
    return long_vec(hd.pool_first(_seqs(spark, sf_dir)), "seq_id")


def pool_max(spark, sf_dir):
    return long_vec(hd.pool_max(_seqs(spark, sf_dir)), "seq_id")


def pool_attention(spark, sf_dir):
    v = vecs(spark, sf_dir)
    return long_vec(hd.pool_attention(hd.as_sequences(v), mean_vector(v)), "seq_id")


def layer_mix(spark, sf_dir):
    return long_vec(hd.layer_mix(_seqs(spark, sf_dir)), "seq_id")


def last_k_concat(spark, sf_dir):
    return long_vec(hd.last_k_concat(_seqs(spark, sf_dir), 4), "seq_id")


def _member_scores(spark, sf_dir):
    v = vecs(spark, sf_dir)
    m = centroid_model(v)
    w = mean_vector(v)
    s = hd.as_sequences(v).withColumn("logits", m.logits("embedding"))
    return s.withColumn("gate", ar.dot("embedding", ar.lit_vector(w)))


def ensemble_mean(spark, sf_dir):
    e = hd.ensemble_mean(_member_scores(spark, sf_dir))
    return e.select("seq_id", F.col("class_idx").cast("bigint").alias("class_idx"), r6("logit").alias("logit"))


def mix_heads(spark, sf_dir):
    mx = hd.mix_heads(_member_scores(spark, sf_dir))
    return mx.select("seq_id", F.posexplode("logits").alias("class_idx", "logit")).select(
        "seq_id", F.col("class_idx").cast("bigint").alias("class_idx"), r6("logit").alias("logit"))
