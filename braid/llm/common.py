"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

# Rows of whole texts and packed arrays are large: so many bytes at a time between Spark and its
# Python workers, on top of the usual number of rows.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _give_back() -> None:
    """Returns the memory a task has freed to the system; a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


# What operators keep in a worker between tasks: name, and how to drop it.
kept: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator], Iterator], own: str = "") -> Callable[[Iterator], Iterator]:
    """A mapInArrow or mapInPandas function that leaves its worker small and
    drops what other operators (not ``own``) have kept there."""
    def wrapped(batches: Iterator) -> Iterator:
        for name, drop in kept.items():
            if name != own:
                drop()
        try:
            yield from run(batches)
        finally:
            _give_back()
    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table of ``sf_dir`` (any file system Spark can read)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, prunes columns later."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a table of keys and small numbers (well under 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, narrow) marked for broadcasting if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key() -> list:
    """Columns ``_id`` and ``_digest`` that tell the rows of a document table apart by id and text; never null."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
            F.md5(F.coalesce("text", F.lit(""))).alias("_digest")]


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    """Number of blocks of about ``per_block`` rows."""
    return max(least, -(-rows // per_block))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph of ``edges`` (``a``, ``b``): one row
    (``v``, ``label``) per vertex with an edge, the label being the smallest
    vertex it can reach.

    Every round takes the smallest label among the neighbours and then follows
    the label's own label, so chains shorten by halves; each round is stored.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                    .select("v", F.least("v", "m").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("v").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m")))
        step = stored(labels.join(near, "v").select("v", F.col("label").alias("old"),
                                                    F.least("label", "m").alias("label")))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = stored(step.join(jump, "label").select("v", "old", F.col("far").alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
