"""The bench's scale evidence is of tenfold input by default, and every copy has ids of its own."""

from pyspark.sql import functions as F

import bench

SF = "/root/testdata/sf0.001"


def test_replicate(spark):
    assert bench.REPLICATE == 10
    out = bench.replicate(spark, SF, bench.REPLICATE)
    for table, key in (("documents", "doc_id"), ("labels", "doc_id"), ("benchmark", "item_id"), ("embeddings", "vec_id")):
        one, many = (spark.read.parquet(f"{d}/{table}.parquet") for d in (SF, out))
        assert many.count() == bench.REPLICATE * one.count()
        assert many.select(key).distinct().count() == bench.REPLICATE * one.select(key).distinct().count()
        assert many.agg(F.max(key)).first()[0] > 9_000_000_000 - 1
