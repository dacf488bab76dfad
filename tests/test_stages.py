"""Stages are built once per state of their input tables."""

import os
import shutil

from braid.plans import stages


def test_a_changed_table_makes_a_new_stage(spark, tmp_path):
    for t in stages._INPUTS:
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    built = []
    get = lambda: stages.stage(spark, str(tmp_path), "test", lambda: built.append(1) or len(built))
    assert get() == get() == 1
    spark.range(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/labels.parquet")
    assert get() == get() == 2
    one = next(f for f in os.listdir(f"{tmp_path}/documents.parquet") if f.endswith(".parquet"))
    shutil.copy(f"{tmp_path}/documents.parquet/{one}", f"{tmp_path}/documents.parquet/again-{one}")
    assert get() == get() == 3
