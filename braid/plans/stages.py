"""Materialised stages shared by queries of one session.

A stage (the split table, the token table, the scored rows, the step log) is
computed once per application and input, written as Parquet below the shared
folder named by ``spark.checkpoint.dir`` and read again by later queries: the
lineage ends there (a lost executor re-reads the files), later scans read only
the columns they use, and filters on partition columns skip whole folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_MEMO: dict[tuple, object] = {}
# Tables the stages are built from; a changed one (in number, bytes or time of its files) makes a new stage.
_INPUTS = ("documents", "labels", "conversations", "benchmark", "embeddings")


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, last change) below ``path`` as its file system knows them; no file names come to the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(p)
    return held.getFileCount(), held.getLength(), fs.getFileStatus(p).getModificationTime()


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    root = sf_dir.rstrip("/")
    return (spark.sparkContext.applicationId, root, name,
            *(table_state(spark, f"{root}/{t}.parquet") for t in _INPUTS))


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Memoised object for this application, folder and the files in it."""
    k = _key(spark, sf_dir, name)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder (in folders of
    ``partition_by``) and return the table read from there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def materialize_by(make: Callable[[str], DataFrame], column: str, values: tuple[str, ...]) -> DataFrame:
    """Like ``materialize`` for wide rows: ``make(value)`` gives those of a folder, and the folders are written one after the
    other, so no task sorts its rows by folder."""
    path = None
    for v in values:
        df = make(v)
        path = path or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stages/{uuid.uuid4().hex}"
        df.drop(column).write.option("compression", "zstd").parquet(f"{path}/{column}={v}")
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame, *scans: DataFrame) -> DataFrame:
    """``df`` dealt out over all task slots if each of the plain table ``scans``
    it comes from has fewer partitions than that (one small file); an input
    with more partitions is left as it is, without a shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if any(s.rdd.getNumPartitions() >= slots for s in scans) else df.repartition(slots)


def clear() -> None:
    """Forget memoised stages (the bench measures every stage from scratch)."""
    _MEMO.clear()
