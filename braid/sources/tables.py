"""Driver tables and the per-task example sources built from them.

Each task has a *labelled* source (train/dev are split from it) and a *test*
source (unlabelled rows).  All sources project to the same normalised schema::

    task STRING, id BIGINT, text_a STRING, text_b STRING, label STRING

Only the columns a source needs are selected, so the Parquet scans read just
those columns (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

EXAMPLE_COLUMNS = ("task", "id", "text_a", "text_b", "label")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _shape(df: DataFrame, task: str) -> DataFrame:
    cols = {
        "task": F.lit(task),
        "id": F.col("id").cast("bigint"),
        "text_a": F.col("text_a"),
        "text_b": F.col("text_b") if "text_b" in df.columns else F.lit(None).cast("string"),
        "label": F.col("label") if "label" in df.columns else F.lit(None).cast("string"),
    }
    return df.select(*[c.alias(n) for n, c in cols.items()])


# --- quality: documents joined with labels ---------------------------------

def quality_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    df = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("text_a"),
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"),
                 F.col("toxic").cast("string")).alias("label"),
    )
    return _shape(df, "quality")


def quality_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    df = docs.join(labels, "doc_id", "left_anti").select(
        F.col("doc_id").alias("id"), F.col("text").alias("text_a"))
    return _shape(df, "quality")


# A turn pair's id is conv_id * 2**24 + turn: one number per (conv_id, turn).
TURN_BITS = 24


def pair_id(conv_id, turn):
    """Id of a turn pair; a turn or conversation out of range fails the query
    instead of meeting another pair's id."""
    ok = (turn >= 0) & (turn < (1 << TURN_BITS)) & (F.abs(conv_id) < (1 << (62 - TURN_BITS)))
    return F.when(ok, F.shiftleft(conv_id.cast("bigint"), TURN_BITS) + turn).otherwise(
        F.raise_error(F.lit("conv_id or turn out of the range of pair ids")).cast("bigint"))


# --- turns: consecutive (labelled) or two-apart (test) conversation turns ---

def _turn_pairs(spark: SparkSession, sf_dir: str, gap: int, labelled: bool) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = conv.alias("a")
    b = conv.alias("b")
    # Equi join on both key columns: (conv_id, turn) is unique, so even a
    # conversation holding a large share of all turns spreads over partitions.
    pairs = a.join(
        b,
        (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + gap),
    )
    cols = [
        pair_id(F.col("a.conv_id"), F.col("a.turn")).alias("id"),
        F.col("a.text").alias("text_a"),
        F.col("b.text").alias("text_b"),
    ]
    if labelled:
        cols.append(F.concat(F.col("a.role"), F.lit(">"), F.col("b.role")).alias("label"))
    return _shape(pairs.select(*cols), "turns")


def turns_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pairs(spark, sf_dir, 1, True)


def turns_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pairs(spark, sf_dir, 2, False)


# --- lang: documents labelled by language; benchmark items as test ----------

def lang_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("text_a"), F.col("lang").alias("label"))
    return _shape(df, "lang")


def lang_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("text_a"))
    return _shape(df, "lang")


LABELLED = {"quality": quality_labelled, "turns": turns_labelled, "lang": lang_labelled}
TEST = {"quality": quality_test, "turns": turns_test, "lang": lang_test}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``vec`` task: one 64-d vector per row, 10 classes."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("int").alias("label"),
    )
