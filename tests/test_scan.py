"""Blocked scans against plain sums, and a log of a million steps."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from braid.operators import monitor, scan, weighting


def table(spark, n=500, seed=1):
    g = np.random.default_rng(seed)
    rows = [("a" if k % 3 else "b", int(e), int(s), None if g.random() < 0.1 else float(g.random()))
            for e in (1, 2, 5) for k, s in enumerate(np.sort(g.choice(4 * n, n, replace=False)))]
    return spark.createDataFrame(rows, "run string, epoch int, step long, x double")


@pytest.mark.parametrize("block", [2, 7, 4096])
@pytest.mark.parametrize("before", [False, True])
def test_running(spark, block, before):
    df = table(spark)
    w = Window.partitionBy("run", "epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    got = scan.running(df, ["run", "epoch"], "step", {"s": ("sum", "x"), "m": ("max", "x")}, block=block, before=before)
    want = df.withColumn("s", F.sum("x").over(w)).withColumn("m", F.max("x").over(w))
    key = ["run", "epoch", "step"]
    a, b = (d.select(*key, "x", F.round("s", 9), "m").orderBy(*key).collect() for d in (got, want))
    assert a == b and len(a) == 1500


@pytest.mark.parametrize("block", [3, 16])
def test_place_and_lag(spark, block):
    df = table(spark)
    w = Window.partitionBy("run").orderBy("epoch", "step")
    placed = scan.place(df, ["run"], "epoch", "step", "g", block=block)
    got = scan.lagged(placed, ["run"], "g", {"l1": ("x", 1), "l2": ("x", 2)}, block)
    want = df.select("*", F.row_number().over(w).cast("long").alias("g"), F.lag("x", 1).over(w).alias("l1"), F.lag("x", 2).over(w).alias("l2"))
    key = ["run", "epoch", "step"]
    assert got.orderBy(*key).collect() == want.orderBy(*key).collect()


@pytest.mark.parametrize("mode", ["paper", "current", "reference"])
def test_dwa_does_not_depend_on_blocks(spark, mode):
    df = table(spark, 60)
    log = df.select(F.lit("r").alias("run_id"), "epoch", "step", F.col("run").alias("task"), F.coalesce("x", F.lit(0.0)).alias("loss"))
    log = log.unionByName(log.withColumn("task", F.concat("task", F.lit("2"))))
    rows = [sorted(map(tuple, weighting.dwa(log, mode=mode, block=b).collect())) for b in (3, 4096)]
    assert rows[0] == rows[1] and len(rows[0]) == 360


def test_empty(spark):
    log = spark.createDataFrame([], "run_id string, epoch long, step long, task string, loss double, acc double")
    assert weighting.dwa(log).collect() == [] and monitor.running_loss(log).collect() == []


def test_a_million_steps(spark):
    """One epoch of one run: right values, and blocks dealt out evenly."""
    n = 1_000_000
    step = F.col("id") + 1
    log = spark.range(0, n, 1, 8).select(
        F.lit("r").alias("run_id"), F.lit(1).cast("long").alias("epoch"), step.alias("step"),
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("task")).withColumn(
        "loss", F.when(F.col("task") == "a", 1 + F.col("step") % 7).otherwise(2.0 + F.col("step") % 3).cast("double"))
    s = np.arange(1, n + 1)
    total = (1 + s % 7) + (2.0 + s % 3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        run = monitor.running_loss(log).select("step", "running_loss", F.spark_partition_id().alias("p")).toPandas().sort_values("step")
        assert np.allclose(run["running_loss"], np.cumsum(total) / s)
        tasks = run.groupby("p").size()
        assert len(tasks) == 8 and tasks.max() <= 2 * tasks.median()
        d = weighting.dwa(log)
        assert "Window" in d._jdf.queryExecution().executedPlan().toString()
        w = d.filter("task = 'a'").select("step", "weight").toPandas().sort_values("step")["weight"].to_numpy()
        a, b = 1.0 + s % 7, 2.0 + s % 3
        ea, eb = np.exp(a[1:-1] / a[:-2] / 2), np.exp(b[1:-1] / b[:-2] / 2)
        assert np.allclose(w[:2], 1) and np.allclose(w[2:], 2 * ea / (ea + eb))
        lag = scan.lagged(scan.place(log, ["run_id", "task"], "epoch", "step", "g"), ["run_id", "task"], "g", {"l": ("loss", 1)})
        tasks = lag.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
        assert len(tasks) == 8 and tasks.max() <= 2 * tasks.median()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_window_over_a_whole_run():
    """Windows of the log's scans are partitioned by block, or by one step."""
    import inspect
    import re
    for module in (weighting, scan):
        for keys in re.findall(r"Window\.partitionBy\(([^)]*)\)", inspect.getsource(module)):
            assert "_block" in keys or "step" in keys
