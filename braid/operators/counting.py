"""Tokens counted inside their row (G2, H11, H12 inputs).

A row's tokens become three arrays in one pass: each different token, its hash slot of the gradient heads (``slots``) and its
count (``times``), ordered by slot and count.  ``packed`` has slots and counts as the bytes of ``gradient.CELL``, for passes that skip most rows;
``counts`` has all in one array of (``token``, ``cnt``, ``slot``).  Stored are ``times``, ``packed`` and ``tokens``, the tokens of a row
joined by spaces, of which a token has none: one value a row instead of one a token.  Nothing is shuffled and no token becomes a row of its own until a join or a sum needs it.  The pass is Arrow batches: texts are cut into tokens there
(``tokens``) and dictionary-encoded, so strings are hashed once per batch.

Rows that share their key (``task``, ``split``, ``id``), and rows without an id, count as one row of tokens, as a grouping by the
key gives it; they are found from the keys alone (``repeated_keys``) and only they are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import gradient as gr
from . import tokens as tk

KEYS = ["task", "split", "id"]
COUNTS = "tokens string, slots array<int>, times array<int>, packed binary"
# Bytes of texts between Spark and a Python worker at a time.
BATCH_BYTES = 8 << 20


def slots_of(tokens: list[bytes]) -> np.ndarray:
    """``gradient.slot_of`` at ``FEATURES`` slots."""
    md5 = hashlib.md5
    return (np.frombuffer(b"".join([md5(t).digest()[:4] for t in tokens]), ">u4") % gr.FEATURES).astype(np.int32)


def counts_of(tokens: pa.Array, row: np.ndarray, rows: int) -> list[pa.Array]:
    """The different tokens of each of ``rows`` rows, their slots and counts, by slot and count; and both packed.  ``row``: the row each token is in."""
    words = tokens.dictionary_encode()
    kinds = max(1, len(words.dictionary))
    slots = slots_of(words.dictionary.cast(pa.binary()).to_pylist())
    # Numbered by slot, a row's tokens sort by slot.
    order = np.argsort(slots, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    key = np.sort(row * kinds + number[words.indices.to_numpy()]) if len(row) else np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key))
    row, code = np.divmod(key[first], kinds)
    code = order[code] if len(code) else code
    slot = slots[code]
    same = np.flatnonzero((np.diff(row) == 0) & (np.diff(slot) == 0))
    if len(same):  # tokens of a row that share their slot, by count
        some = np.unique(np.concatenate([same, same + 1]))
        code[some], n[some] = (x[some][np.lexsort((n[some], slot[some], row[some]))] for x in (code, n))
    edge = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32))
    parts = words.dictionary.take(pa.array(code)), pa.array(slot), pa.array(n.astype(np.int32))
    cells = np.empty(len(slot), gr.CELL)
    cells["slot"], cells["cnt"] = slot, n
    packed = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edge.to_numpy() * np.int32(gr.CELL.itemsize)), pa.py_buffer(cells)])
    words, *numbers = (pa.ListArray.from_arrays(edge, x) for x in parts)
    return [pc.binary_join(words, " "), *numbers, packed]


def _count(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        kept = [c for c in whole.schema.names if c not in ("text_a", "text_b")]
        both = [tk.tokens_of(whole.column(c), table) for c in ("text_a", "text_b")]
        row = np.concatenate([np.repeat(np.arange(whole.num_rows), size) for _, size in both])
        counts = counts_of(pa.concat_arrays([t for t, _ in both]), row, whole.num_rows)
        yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in kept), *counts], names=[*kept, "tokens", "slots", "times", "packed"])


def _by_texts(rows: DataFrame, make, columns: str) -> DataFrame:
    """Keys and ``label_idx`` of ``rows`` with the ``columns`` that ``make`` (batches, kinds of characters) finds in their texts."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kept = [*KEYS, *(["label_idx"] if "label_idx" in rows.columns else [])]
    given = rows.select(*kept, F.lower("text_a").alias("text_a"), F.lower("text_b").alias("text_b"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name in kept)
    kinds = tk.kinds(spark)
    return given.mapInArrow(lambda batches: make(batches, np.frombuffer(kinds.value, np.uint8)), f"{schema}, {columns}")


def counted_rows(rows: DataFrame) -> DataFrame:
    """One row per row of ``rows``: keys, ``label_idx`` and the counts of the tokens of both whole texts."""
    counts = F.arrays_zip(token_array().alias("token"), F.col("times").cast("array<bigint>").alias("cnt"), F.col("slots").alias("slot"))
    return _by_texts(rows, _count, COUNTS).withColumn("counts", counts)


def token_array() -> Column:
    """The ``tokens`` of a counted row as an array."""
    return F.when(F.col("tokens") == "", F.array().cast("array<string>")).otherwise(F.split("tokens", " "))


def token_counts() -> Column:
    """Each ``token`` of a counted row with its ``cnt``, as rows."""
    return F.explode(F.arrays_zip(token_array().alias("token"), F.col("times").cast("array<bigint>").alias("cnt")))


def framed_rows(rows: DataFrame) -> DataFrame:
    """One row per row of ``rows``: keys, ``label_idx`` and the framed sequence (as ``features.sequences`` gives it)."""
    return _by_texts(rows, tk.frame_batches, tk.FRAMED)


def repeated_keys(counted: DataFrame, keep) -> DataFrame | None:
    """Keys that several rows share, or without an id; none: nothing to group."""
    found = keep(counted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").select(*KEYS))
    return None if found.isEmpty() else found


def with_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is (``left_semi``) or is not (``left_anti``) among ``keys``; null is a key like others."""
    other = keys.select(*[F.col(k).alias(f"_k_{k}") for k in KEYS])
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in KEYS], how)


def long_counts(counted: DataFrame) -> DataFrame:
    """(keys, ``label_idx``, ``token``, ``cnt``): a row for each different token of a row."""
    return counted.select(*KEYS, "label_idx", token_counts().alias("_t")).select(
        *KEYS, "label_idx", "_t.token", "_t.cnt")


def grouped_counts(counted: DataFrame, repeated: DataFrame) -> DataFrame:
    """``long_counts`` of the rows of ``repeated`` keys, added up by key."""
    return long_counts(with_keys(counted, repeated, "left_semi")).groupBy(*KEYS, "token").agg(
        F.max("label_idx").alias("label_idx"), F.sum("cnt").alias("cnt")).select(*KEYS, "label_idx", "token", "cnt")
