"""Structured Streaming forms of the training-loop monitors (K1, K2).

K1 keeps a running per-task confusion table as prediction rows arrive: a
streaming aggregate (state per (task, split, label, prediction) cell) in
update mode.  Every micro-batch hands over the cells that changed; they are merged by key
into the table of the version before, and the result is written as the version of
the batch id, with accuracy and macro-F1 derived from it.  A batch that runs again writes the
same version again, and a reader takes the last version that is complete, so nobody sees half a table.
The final state equals the batch confusion (D8) and metrics (D9, D10).

K2 scores arriving vectors with a fitted linear head: a stateless
stream-static projection (the head is a literal model, no join).

Both read a Parquet file source and write Parquet under the shared checkpoint
folder, with a streaming checkpoint location, so a restarted query resumes
where it stopped.  The ``availableNow`` trigger processes what is there and
stops.  No server or port is involved.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import metrics as mt
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def running_confusion(stream: DataFrame, keys=("task", "split")) -> DataFrame:
    """K1 (streaming): cell counts per (keys, label_idx, pred_idx)."""
    return (stream.filter(F.col("label_idx").isNotNull())
            .groupBy(*keys, "label_idx", "pred_idx").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def confusion_metrics(conf: DataFrame, keys=("task", "split")) -> DataFrame:
    """D9/D10 from a confusion table: ``accuracy``, ``macro_f1`` and ``n`` per key."""
    keys = list(keys)
    n = F.sum("n")
    acc = conf.groupBy(*keys).agg(
        (F.sum(F.when(F.col("label_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)) / n).alias("accuracy"),
        n.cast("bigint").alias("n"))
    f1 = mt.per_class(conf, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return acc.join(f1, keys)


def _files(reader, files_per_trigger: int | None):
    """A file stream that takes all new files per trigger, or so many."""
    return reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)


CELL = ("task", "split", "label_idx", "pred_idx")


def versions(spark: SparkSession, out_dir: str) -> list[int]:
    """Complete versions of a table that is written batch by batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def current(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last complete version."""
    return spark.read.parquet(f"{out_dir}/v={versions(spark, out_dir)[-1]}")


def merge_changed(changed: DataFrame, out_dir: str, batch: int, keys=CELL) -> DataFrame:
    """Writes version ``batch``: the ``changed`` rows, and those of the version before with other keys."""
    spark = changed.sparkSession
    earlier = [v for v in versions(spark, out_dir) if v < batch]
    merged = changed
    if earlier:
        before = spark.read.schema(changed.schema).parquet(f"{out_dir}/v={earlier[-1]}")
        merged = changed.unionByName(before.join(changed.select(*keys), list(keys), "left_anti"))
    path = f"{out_dir}/v={batch}"
    merged.write.mode("overwrite").parquet(path)
    return spark.read.schema(changed.schema).parquet(path)


def run_running_confusion(spark: SparkSession, source_dir: str, schema, out_dir: str, ckpt_dir: str,
                          files_per_trigger: int | None = None, metrics_dir: str | None = None) -> None:
    """Drive K1 over ``source_dir`` until all files are processed."""
    # The state has one row per confusion cell (tasks x classes^2), so it needs
    # few state partitions; they are set on a session of the query's own.
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    stream = _files(own.readStream.schema(schema), files_per_trigger).parquet(source_dir)

    def sink(batch: DataFrame, number: int) -> None:
        changed = batch.persist()  # the state is asked once
        done = merge_changed(changed, out_dir, number)
        if metrics_dir:
            confusion_metrics(done).write.mode("overwrite").parquet(f"{metrics_dir}/v={number}")
        changed.unpersist()

    q = (running_confusion(stream).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def score_stream(stream: DataFrame, model) -> DataFrame:
    """K2 (streaming): predicted class of each arriving vector."""
    return stream.select("vec_id", ar.argmax(model.logits("embedding")).cast("bigint").alias("pred_idx"))


def run_score_stream(spark: SparkSession, source_dir: str, schema, model, out_dir: str, ckpt_dir: str,
                     files_per_trigger: int | None = None) -> None:
    stream = _files(spark.readStream.schema(schema), files_per_trigger).parquet(source_dir)
    q = (score_stream(stream, model).writeStream.format("parquet").outputMode("append")
         .option("path", out_dir).option("checkpointLocation", ckpt_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
