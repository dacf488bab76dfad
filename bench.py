"""Benchmark: the end-to-end pipeline (prepare -> features -> NB heads ->
losses/metrics -> training log/weighting -> robustness) on one folder.

Each stage reuses the stages before it (materialised once, as in a real run)
and is timed separately; ``value`` is the end-to-end total.  ``replicated`` has
the heavy stages again on ``BENCH_REPLICATE`` (10) copies of the tables, with
rows a second.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def full(df) -> None:
    """Computes every column of every row."""
    df.write.format("noop").mode("overwrite").save()


# Copies of the tables for the scale figures.
REPLICATE = 10


def replicate(spark, sf_dir: str, times: int) -> str:
    """The text tables ``times`` over, each copy with ids of its own, in the shared scratch folder."""
    from pyspark.sql import functions as F

    from braid.streaming.running import scratch
    out = scratch(spark, f"bench-x{times}")
    copy = F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<bigint>"))
    for table, key in (("documents", "doc_id"), ("labels", "doc_id"), ("conversations", "conv_id"),
                       ("benchmark", "item_id"), ("embeddings", "vec_id")):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("_copy", copy)
        df.withColumn(key, F.col(key) + F.col("_copy") * 1_000_000_000).drop("_copy").write.parquet(f"{out}/{table}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from braid.plans import robustness as rb
    from braid.plans import stages
    from braid.plans.catalog import queries
    from braid.session import build_session

    spark = build_session(master=f"local[{cpus}]", partitions=int(cpus) * 2, app="braid-bench")
    q = queries()
    stages.clear()

    def run(fn):
        t0 = time.time()
        fn()
        return round(time.time() - t0, 3)

    times: dict[str, float] = {}
    # Warm the JVM once on a tiny query (not timed).
    q["label_dim"](spark, sf_dir).collect()
    times["prepare_split_summary"] = run(lambda: q["split_summary"](spark, sf_dir).collect())
    times["batches_lockstep"] = run(lambda: q["lockstep"](spark, sf_dir).collect())
    times["features"] = run(lambda: q["length_check"](spark, sf_dir).collect())
    times["nb_fit_score"] = run(lambda: full(q["nb_predictions"](spark, sf_dir)))
    times["losses_metrics"] = run(lambda: [q[n](spark, sf_dir).collect() for n in
                                          ("cross_entropy", "focal", "dice", "macro_f1", "evaluate")])
    times["steplog_weighting"] = run(lambda: [q[n](spark, sf_dir).collect() for n in
                                             ("dwa_weights", "total_loss", "best_so_far", "early_stop")])
    times["submission"] = run(lambda: q["submission"](spark, sf_dir).collect())
    times["robustness"] = run(lambda: rb.robustness(spark, sf_dir).collect())
    total = round(sum(times.values()), 3)
    scaled = {}
    factor = int(os.environ.get("BENCH_REPLICATE", str(REPLICATE)))
    if factor > 1:  # the same stages on copies of the tables: time per row should not grow
        big = replicate(spark, sf_dir, factor)
        rows = q["examples"](spark, big).count()
        for name, fn in (("prepare_split_summary", lambda: q["split_summary"](spark, big).collect()),
                         ("features", lambda: full(q["features"](spark, big))),
                         ("nb_fit_score", lambda: full(q["nb_predictions"](spark, big)))):
            sec = run(fn)
            scaled[name] = {"sec": sec, "rows_per_sec": round(rows / sec)}
        scaled["factor"], scaled["rows"] = factor, rows
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "pipeline_wall_time", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": int(cpus), "replicated": scaled}))
    spark.stop()


if __name__ == "__main__":
    main()
