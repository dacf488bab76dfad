"""Queries that drive the streaming monitors and the split sink/source round
trip.  Inputs are written from the driver's tables (via Spark) into the
shared checkpoint folder, then consumed as a stream / read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import TASKS
from ..operators import examples as ex
from ..operators.common import r6
from ..sources import tsv
from ..streaming import running as rs
from .prepare import Prepared
from .stages import stage
from .textmodels import NBScores
from .vectors import centroid_model, vecs


# Files per micro-batch of the registered streams (several micro-batches on small inputs).
FILES_PER_TRIGGER = 3


def _streamed_confusion(spark, sf_dir):
    """(confusion, metrics) after all prediction files have streamed in."""
    def build():
        nb = NBScores.get(Prepared.get(spark, sf_dir))
        preds = nb.predictions().filter(F.col("split") != "test").select(
            "task", "split", "id", "label_idx", "pred_idx")
        src, out, ck = rs.scratch(spark, "k1-src"), rs.scratch(spark, "k1-out"), rs.scratch(spark, "k1-ck")
        metrics = rs.scratch(spark, "k1-metrics")
        preds.write.parquet(src)
        rs.run_running_confusion(spark, src, preds.schema, out, ck, FILES_PER_TRIGGER, metrics)
        return rs.current(spark, out), rs.current(spark, metrics)
    return stage(spark, sf_dir, "k1", build)


def stream_confusion(spark, sf_dir):
    """K1: the running confusion after the last micro-batch (equals D8 on the same rows)."""
    return _streamed_confusion(spark, sf_dir)[0].select(
        "task", "split", F.col("label_idx").cast("bigint").alias("label_idx"),
        F.col("pred_idx").cast("bigint").alias("pred_idx"), "n")


def stream_metrics(spark, sf_dir):
    """K1: accuracy and macro-F1 as written by the last micro-batch (equal D9 and D10)."""
    return _streamed_confusion(spark, sf_dir)[1].select(
        "task", "split", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


def stream_scores(spark, sf_dir):
    """K2: streamed centroid-head predictions for every vector."""
    v = vecs(spark, sf_dir)
    model = centroid_model(v)
    src, out, ck = rs.scratch(spark, "k2-src"), rs.scratch(spark, "k2-out"), rs.scratch(spark, "k2-ck")
    v.write.parquet(src)
    rs.run_score_stream(spark, src, v.schema, model, out, ck, FILES_PER_TRIGGER)
    return spark.read.parquet(out).select("vec_id", "pred_idx")


# --- raw and header TSV round trips ---------------------------------------------

def _one_line(df):
    """Texts with tabs and line breaks turned into spaces, as a TSV line can hold them."""
    return df.withColumns({c: F.regexp_replace(c, "[\t\n\r]", " ") for c in ("text_a", "text_b")})


def _routed(spark, sf_dir):
    def build():
        e, root = _one_line(ex.load_examples(spark, sf_dir)), rs.scratch(spark, "raw")
        for t in TASKS:
            texts = ["text_a", "text_b"] if t.kind == "pair" else ["text_a"]
            own = e.filter(F.col("task") == t.name)
            tsv.write_raw_tsv(own.filter("kind = 'labelled'").select("id", *texts, "label"), f"{root}/{t.name}_train.csv")
            tsv.write_raw_tsv(own.filter("kind = 'test'").select("id", *texts), f"{root}/{t.name}_a.csv")
        return root
    return tsv.route_sources(spark, stage(spark, sf_dir, "raw_tsv", build), TASKS)


def routed_sources(spark, sf_dir):
    """A1/A2/B1: the examples written as headerless TSV files and routed back by their names."""
    return _routed(spark, sf_dir).select("task", "kind", "id", "label", F.md5("text_a").alias("md5_a"),
                                         F.md5(F.coalesce("text_b", F.lit(""))).alias("md5_b"))


def raw_tsv_counts(spark, sf_dir):
    """A1: rows per task and kind of the routed files."""
    return _routed(spark, sf_dir).groupBy("task", "kind").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def header_tsv_splits(spark, sf_dir):
    """A5 + A3 as header TSV: the split table written and read back with its schema."""
    p = Prepared.get(spark, sf_dir)
    out, rows = rs.scratch(spark, "splits-tsv"), _one_line(p.splits)
    tsv.write_splits(rows, out, "tsv")
    kept = [f for f in rows.schema.fields if f.name not in ("task", "split")]
    back = tsv.read_split(spark, out, fmt="tsv", schema=StructType([*kept, rows.schema["task"], rows.schema["split"]]))
    return back.select("task", "id", "label", "split", F.md5("text_a").alias("md5_a"),
                       F.md5(F.coalesce("text_b", F.lit(""))).alias("md5_b"))


def written_splits(spark, sf_dir):
    """A5 + A3: write the split table partitioned by (task, split) and read it
    back (partition-pruned per split)."""
    p = Prepared.get(spark, sf_dir)
    out = rs.scratch(spark, "splits")
    tsv.write_splits(p.splits, out)
    parts = [tsv.read_split(spark, out, split=s) for s in ("train", "dev", "test")]
    back = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return back.select("task", "id", "label", "split", F.length("text_a").cast("bigint").alias("len_a"),
                       F.md5(F.coalesce("text_a", F.lit(""))).alias("md5_a"),
                       F.md5(F.coalesce("text_b", F.lit(""))).alias("md5_b"))
