"""From raw documents to packed training sequences.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a data
frame, which ``run`` writes as Parquet and reads again for the next one.  All but the
last return the columns of ``documents``.

1. language: documents without a language, or with two that fit almost alike, go.
2. near_duplicates: one document of each group of near copies stays, the one
   with the smallest id (equal ids: the smallest digest of the text).
3. secrets: secrets in texts are masked; no document goes.
4. mix: documents are taken as often as the mix of sources takes them (0 to 3
   times), one row each time.
5. pack: token sequences; one row per piece with its ids.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables; see the operators for what each gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import langid, mixing, ngram_join, packing, secret_scan
from braid.llm.common import read_table, row_key, ship_package, small_batches, small_side, stored

# Five-word shingles and a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def prepare(spark: SparkSession) -> None:
    """Settings the stages run under."""
    ship_package(spark)
    small_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    told = langid.identify(docs, langid.fit(docs))
    return told.filter(~F.col("ambiguous")).select(*docs.columns)


def first_of(rows: DataFrame, keys: list[str], repeated: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows``; of those that share one of the ``repeated`` keys only the
    first in the order of the columns.  Other rows are not shuffled."""
    if repeated.isEmpty():
        return rows.select(*columns)
    repeated = small_side(repeated)
    first = rows.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_row"))
    return rows.join(repeated, keys, "left_anti").select(*columns).unionByName(first.select("_row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    joined = stored(ngram_join.ngram_join(docs, NEAR_WORDS, NEAR_PERCENT).select(
        "component", "n_shingles", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest").alias("row")))
    groups = joined.groupBy("component").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = (joined.join(groups, "component").filter("row <> first")
            .select(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")).alias("_id"),
                    F.col("row.digest").alias("_digest")))
    kept = docs.select("*", *row_key()).join(small_side(stored(gone.distinct())), ["_id", "_digest"], "left_anti")
    # Of rows with equal id and text, one stays; those without words are linked with nothing and all stay.
    again = (joined.filter("n_shingles > 0").groupBy("row").count().filter("count > 1")
             .select(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")).alias("_id"),
                     F.col("row.digest").alias("_digest")))
    return first_of(kept, ["_id", "_digest"], stored(again), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redact(docs, secret_scan.scan(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select("*", *row_key())
    rows = keyed.select(F.concat_ws("|", "_id", "_digest").alias("doc_id"), "source",
                        mixing.word_count(F.col("text")).alias("size"))
    taken = (mixing.mix(rows).groupBy(F.col("doc_id").alias("_key"))
             .agg(F.sum("rounds").alias("_rounds"), F.count(F.lit(1)).alias("_same")))
    taken = stored(taken)
    keyed = keyed.withColumn("_key", F.concat_ws("|", "_id", "_digest"))
    # Rows alike stand for each other.
    keyed = first_of(keyed, ["_key"], taken.filter("_same > 1").select("_key"), [*docs.columns, "_key"])
    chosen = keyed.join(small_side(taken.filter("_rounds > 0").select("_key", "_rounds")), "_key")
    return chosen.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_rounds").cast("int"))).alias("_round")).drop("_round")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # Places are found from the lengths alone; the ids come to them by piece.
    pieces = stored(packing.tokenise(docs).withColumn("piece", F.monotonically_increasing_id()))
    placed = stored(packing.pack(pieces.drop("ids"), docs.count()).select("piece", "sequence_id", "offset"))
    return pieces.join(small_side(placed), "piece").drop("piece")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

# Hashing, training and packing are not SQL; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
