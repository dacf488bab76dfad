"""Two-stage bucketed ranks equal the plain window; checked broadcast."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from braid.operators.common import checked_broadcast, order_key
from braid.plans.ranking import hex_bucket, in_ranges, quantile_bucket, range_rank, two_stage_rank


def test_two_stage_rank_equals_window(spark):
    # One hot group holding most rows, plus small groups.
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 7}", 10_000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, id bigint").withColumn("_key", order_key("id", 2020))
    got = two_stage_rank(df, ["grp"], ["_key", "id"], hex_bucket("_key", 2), "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("_key", "id")))
    assert {tuple(r) for r in got.select("grp", "id", "r").collect()} == \
           {tuple(r) for r in want.select("grp", "id", "r").collect()}


def test_two_stage_rank_by_id_range(spark):
    df = spark.createDataFrame([("t", i * 7 + 3) for i in range(500)], "grp string, id bigint")
    got = two_stage_rank(quantile_bucket(df, ["grp"], "id"), ["grp"], ["id"], out="r")
    assert [r["r"] for r in got.orderBy("id").collect()] == list(range(1, 501))


def test_quantile_buckets_stay_even(spark):
    # One outlier id, and a group whose ids are of another scale.
    rows = [("a", i) for i in range(4000)] + [("a", 10 ** 15)] + [("b", 10 ** 12 + 1000 * i) for i in range(800)]
    df = spark.createDataFrame(rows, "grp string, id bigint")
    b = quantile_bucket(df, ["grp"], "id", rows_per_bucket=100)
    sizes = {}
    for r in b.groupBy("grp", "_bkt").count().collect():
        sizes.setdefault(r["grp"], []).append(r["count"])
    assert all(max(s) <= 2 * sum(s) / len(s) for s in sizes.values())
    ranked = two_stage_rank(b, ["grp"], ["id"], out="r").orderBy("grp", "id").collect()
    assert [r["r"] for r in ranked] == [*range(1, 4002), *range(1, 801)]


def _hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_checked_broadcast_checks_rows_and_bytes(spark):
    small = spark.range(100).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert _hinted(checked_broadcast(small))
    assert not _hinted(checked_broadcast(small, max_rows=5))
    assert not _hinted(checked_broadcast(small, max_bytes=50_000))
    for limit in (5, 1000):
        assert spark.range(100).join(checked_broadcast(small, max_rows=limit), "id").count() == 100
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_range_rank_equals_window(spark):
    from pyspark.sql import Window
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("grp"), (F.col("id") * 7919 % 101).alias("n"), F.col("id").alias("t"))
    order = [F.col("n").desc(), "t"]
    for part in ([], ["grp"]):
        want = df.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint"))
        assert sorted(range_rank(df, part, order, "r").collect()) == sorted(want.collect())
    assert range_rank(df.limit(0), ["grp"], ["t"], "r").collect() == []


def test_ranges_stay_even_under_a_shared_prefix(spark):
    """A vocabulary of rare tokens that all begin alike."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tokens = spark.range(0, 60_000, 1, 4).select(F.format_string("prefix%09d", F.col("id") * 104729 % 60_000).alias("token"), F.lit(1).alias("n"))
        sizes = [r["count"] for r in in_ranges(tokens, [F.col("n").desc(), "token"]).groupBy(F.shiftright("_at", 33)).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
