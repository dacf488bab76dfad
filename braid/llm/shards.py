"""Packed document shards and questions between them.

A shard is one row that holds a few MB of whole texts.  An operator that has to
know which of a shard's items (shingles, byte windows) occur elsewhere sends
them in rows of (bucket, shard, payload), one per bucket of item hashes; the
task of a bucket sees all shards' payloads of its hash range and answers in
rows of (shard, bucket, answer).  Shuffled rows are large and few, items cost a
few bytes each, and an item that many documents share is sent once per shard.
A bucket holds about as many items as a shard, or a fixed part of it, however
large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored, tidy

SHARD_BYTES = 4 << 20
SHARD_ROWS = 1 << 16
LEAST_BUCKETS = 32
# A shard number leaves room for the row numbers of its texts in one long.
ROW_BITS = 17
SCHEMA = "shard long, ids binary, nulls binary, lens binary, data binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored shards of a table.  Null text: empty.  Any ids, repeated ones too."""
    ship_package(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            nonlocal ids, texts, size, seq
            number = np.array([0 if i is None else i for i in ids], np.int64)
            out = {"shard": [(part << 20) | seq], "ids": [number.tobytes()],
                   "nulls": [np.array([i is None for i in ids], bool).tobytes()],
                   "lens": [np.array([len(t) for t in texts], np.int64).tobytes()],
                   "data": [compress(b"".join(texts))]}
            ids, texts, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(out, schema=target)
        target = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "lens", "data"))])
        for b in batches:
            texts_of = b.column(1).cast(pa.binary())
            for i, t in zip(b.column(0).to_pylist(), texts_of, strict=True):
                t = t.as_py() or b""
                if texts and (size + len(t) > SHARD_BYTES or len(texts) >= SHARD_ROWS):
                    yield row()
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()
    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), SCHEMA))


def compress(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def decompress(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, size, codec="zstd", asbytes=True) if size else b""


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed byte planes of their differences."""
    gaps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(decompress(blob, 4 * n), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


class Shard:
    """The texts of one shard: ``number``, ``ids``, ``null`` (id is null),
    ``buf`` (all bytes) and ``offs``."""

    def __init__(self, row):
        self.number = int(row.shard)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.null = np.frombuffer(row.nulls, bool)
        self.offs = np.concatenate([[0], np.cumsum(np.frombuffer(row.lens, np.int64))]).astype(np.int64)
        self.buf = np.frombuffer(decompress(row.data, int(self.offs[-1])), np.uint8)
        self.rids = (self.number << ROW_BITS) + np.arange(len(self.ids), dtype=np.int64)

    def parts(self, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last text, bytes, offsets) in runs of about ``limit`` bytes."""
        a = 0
        while a < len(self.ids):
            b = int(np.searchsorted(self.offs, self.offs[a] + limit, "right")) - 1
            b = min(max(b, a + 1), len(self.ids))
            lo, hi = self.offs[a], self.offs[b]
            yield a, b, self.buf[lo:hi], self.offs[a:b + 1] - lo
            a = b


def each_shard(fn, schema: str):
    """A mapInPandas function that applies ``fn(Shard, row)`` (an iterator of
    data frames) to every row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                yield from fn(Shard(row), row)
    return tidy(run)


def ask(shards: DataFrame, fn, schema: str) -> DataFrame:
    return shards.mapInPandas(each_shard(fn, schema), schema)


def with_answers(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """Shards with ``answers``: array of (bucket, answer) of the rows (shard, bucket, answer)."""
    per = answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return shards.join(per, "shard", "left")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of sorted or unsorted 64-bit hashes by range (order is kept)."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_runs(sorted_h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes lie in, and the first index of each (one
    more entry: the length).  Empty buckets cost nothing."""
    if not len(sorted_h):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    of = bucket_of(sorted_h, buckets)
    first = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
    return of[first], np.append(first, len(of))


def placed(sorted_h: np.ndarray, buckets: int, answers) -> np.ndarray:
    """Bits of the answers (rows of bucket and packed bits, or None) in the order of the hashes."""
    out = np.zeros(len(sorted_h), bool)
    here, edge = bucket_runs(sorted_h, buckets)
    for x in answers if answers is not None else ():
        k = np.searchsorted(here, x["bucket"])
        lo, hi = edge[k], edge[k + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(x["answer"], np.uint8), count=hi - lo)
    return out
