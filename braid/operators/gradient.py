"""Softmax heads of several tasks fitted together by gradient steps (H12, and the train and dev side of E5-E8).

All tasks share one hashing of tokens to ``FEATURES`` slots (the first 8 hex digits of the token's
md5, modulo); each has weights of its own and a bias, the slot behind the last.  A row's features are its
token counts divided by their Euclidean norm.

Training goes in blocks of steps, one per evaluation.  A block is one pass over its rows, of all tasks at
once: each row is scored by the heads as they stand (that is its train loss), and the rows' gradients are added up per
partition, then merged by (task, run of slots).  A head moves by its last move times ``MOMENTUM`` less ``RATE`` times the mean gradient;
heads and moves are stored, so every evaluation's heads can be read again and training can go on from the last.  The pass of a block also scores
the evaluation rows.  Documents are not shuffled; what is are the partitions' gradients, runs of slots that none of its rows has left out.

There are as many slots whatever the number of labels.  Heads of up to ``MAX_CELLS`` numbers are broadcast to the pass and held in memory;
larger ones go to the executors as a file and are mapped there, as are sums of gradients and the driver's own copies (``room``): the
numbers are the same.  The pass is Arrow batches through numpy: a row's logits and its share in the gradient are matrix products.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..session import ship_package

FEATURES, MAX_CELLS = 1 << 14, 4_000_000
RATE, MOMENTUM = 2.0, 0.7
# Products of features and classes, or numbers of a head, held at a time by a task.
AT_ONCE = 1 << 20
# Numbers in a row of gradients.
ROW_CELLS = 4096
# Up to so many classes sums are made class by class; that takes a pass over all slots for each of them.
FEW_CLASSES = 64
# A token of a row of packed counts.
CELL = np.dtype([("slot", "<u2"), ("cnt", "<u4")])

PASS = ("kind string, task string, split string, id long, label_idx int, epoch long, step long, "
        "logits array<double>, slot int, grad array<double>")


def slots_for(labels: int) -> int:
    """Slots of the heads of all ``labels``: the same for any number of them."""
    return FEATURES


def matrices(flat: np.ndarray, classes: dict[str, int], slots: int) -> dict[str, np.ndarray]:
    """The parts of ``flat`` as a matrix for each task (slots and the bias x classes)."""
    ends = np.cumsum([(slots + 1) * n for n in classes.values()], dtype=np.int64)
    return {t: flat[e - (slots + 1) * n:e].reshape(slots + 1, n) for (t, n), e in zip(classes.items(), ends, strict=True)}


def cells_of(classes: dict[str, int], slots: int) -> int:
    return (slots + 1) * sum(classes.values())


def room(classes: dict[str, int], slots: int) -> dict[str, np.ndarray]:
    """Zeros for each task's head: in memory, or beyond ``MAX_CELLS`` mapped from a scratch file that goes with them."""
    cells = cells_of(classes, slots)
    flat = np.zeros(cells) if cells <= MAX_CELLS else np.memmap(tempfile.TemporaryFile(), np.float64, "w+", shape=(cells,))
    return matrices(np.asarray(flat), classes, slots)


class Held:
    """Heads as the workers get them: broadcast, or beyond ``MAX_CELLS`` as a file that Spark brings to each executor."""

    def __init__(self, spark: SparkSession, heads: dict[str, np.ndarray]):
        self.classes = {t: w.shape[1] for t, w in heads.items()}
        self.slots = max((len(w) for w in heads.values()), default=1) - 1
        self.name = self.small = None
        if cells_of(self.classes, self.slots) <= MAX_CELLS:
            self.small = spark.sparkContext.broadcast(heads)
            return
        folder = os.path.join(SparkFiles.getRootDirectory(), "shipped")
        os.makedirs(folder, exist_ok=True)
        self.name = f"heads-{uuid.uuid4().hex}"
        with open(os.path.join(folder, self.name), "wb") as out:
            for w in heads.values():
                for a in range(0, len(w), step_of(w)):
                    out.write(w[a:a + step_of(w)].tobytes())
        spark.sparkContext.addFile(out.name)

    def heads(self) -> dict[str, np.ndarray]:
        if self.small is not None:
            return self.small.value
        return matrices(np.asarray(np.memmap(SparkFiles.get(self.name), np.float64, "r")), self.classes, self.slots)


def step_of(w: np.ndarray) -> int:
    """Slots of a head taken at a time."""
    return max(1, AT_ONCE // w.shape[1])


def slot_of(token, slots: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def feature_rows(counts: DataFrame, rows: DataFrame, slots: int, keys=("task", "split", "id")) -> DataFrame:
    """``rows`` with ``slot`` and ``value`` arrays from ``counts`` (``keys``, ``token``, ``cnt``); rows without tokens have empty ones."""
    keys = list(keys)
    packed = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(slot_of(F.col("token"), slots).alias("s"), F.col("cnt").cast("double").alias("c")))).alias("_t"),
        F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("_norm"))
    value = F.transform(F.col("_t"), lambda t: t["c"] / F.col("_norm"))
    return rows.join(packed, keys, "left").select(
        *rows.columns, F.coalesce(F.col("_t.s"), F.array().cast("array<int>")).alias("slot"),
        F.coalesce(value, F.array().cast("array<double>")).alias("value"))


def counted_features(counted: DataFrame, slots: int) -> DataFrame:
    """Rows with ``counts`` (see ``counting``) with their ``slot`` and ``value`` arrays."""
    cnt, slot = F.col("counts.cnt"), F.col("counts.slot")
    norm = F.sqrt(F.aggregate(cnt, F.lit(0).cast("bigint"), lambda a, c: a + c * c))
    # Named once: inside the function of the elements the norm would be computed for each of them.
    value = ar.let(norm, lambda n: F.transform(cnt, lambda c: c.cast("double") / n))
    # Slots are a power of two, so those of a smaller table follow from the larger one's.
    slot = slot if slots == FEATURES else F.transform(slot, lambda s: s % slots)
    return counted.withColumn("value", value).withColumn("slot", slot)


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each row, slots, values) of ``packed`` counts."""
    edge = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    cells = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[edge[0]:edge[-1]].view(CELL)
    start = (edge - edge[0]) // CELL.itemsize
    size, cnt = np.diff(start), cells["cnt"].astype(np.int64)
    full = size > 0
    norm = np.sqrt(np.add.reduceat(cnt * cnt, start[:-1][full])) if full.any() else np.empty(0)
    return size, cells["slot"].astype(np.int32), cnt / np.repeat(norm, size[full])


def logits_of(weights: np.ndarray, start: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One row of class scores for each row of features (``start``: first feature of each row, and the end)."""
    out = np.repeat(weights[-1:], len(start) - 1, axis=0)
    full = np.flatnonzero(np.diff(start))
    if len(full) and weights.shape[1] <= FEW_CLASSES:
        for k in range(weights.shape[1]):
            out[full, k] += np.add.reduceat(value * weights[:, k][slot], start[full])
    elif len(full):
        out[full] += np.add.reduceat(value[:, None] * weights[slot], start[full])
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def run_of(classes: int) -> int:
    """Slots whose gradients are one row: about ``ROW_CELLS`` numbers."""
    return max(1, ROW_CELLS // classes)


def add_gradient(grad: np.ndarray, logits: np.ndarray, label: np.ndarray, start: np.ndarray, slot: np.ndarray, value: np.ndarray) -> None:
    """Adds the cross-entropy gradient of some rows to ``grad`` (slots and the bias x classes)."""
    miss = softmax(logits)
    miss[np.arange(len(label)), label] -= 1
    grad[-1] += miss.sum(axis=0)
    if len(slot) and grad.shape[1] <= FEW_CLASSES:
        size = np.diff(start)
        for k in range(grad.shape[1]):
            grad[:, k] += np.bincount(slot, value * np.repeat(miss[:, k], size), len(grad))
    elif len(slot):
        order = np.argsort(slot, kind="stable")
        row, slot = np.repeat(np.arange(len(label)), np.diff(start))[order], slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        grad[slot[first]] += np.add.reduceat(value[order, None] * miss[row], first)


class Pass:
    """Scores rows under the ``held`` heads (task -> slots + 1 x classes) and adds the gradients of the training rows up."""

    def __init__(self, held: Held):
        self.held = held

    @staticmethod
    def parts(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The rows of each task, with packed features and without."""
        for task in whole.column("task").unique().to_pylist():
            mine = whole.filter(pc.equal(whole.column("task"), task))
            packed = pc.is_null(mine.column("slot"))
            yield from (part for part in (mine.filter(packed), mine.filter(pc.invert(packed))) if part.num_rows)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("task", pa.string()), ("split", pa.string()), ("id", pa.int64()),
                            ("label_idx", pa.int32()), ("epoch", pa.int64()), ("step", pa.int64()),
                            ("logits", pa.list_(pa.float64())), ("slot", pa.int32()), ("grad", pa.list_(pa.float64()))])
        heads = self.held.heads()
        grads: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for mine in (part for whole in batches for part in self.parts(whole)):
            task, a = mine.column("task")[0].as_py(), 0
            w = heads[task]
            if mine.column("slot").null_count:
                size, slots, values = unpacked(mine.column("packed"))
            else:
                size = pc.list_value_length(mine.column("slot")).to_numpy()
                slots, values = (mine.column(c).flatten().to_numpy() for c in ("slot", "value"))
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            cost = np.cumsum(size + w.shape[1] if w.shape[1] <= FEW_CLASSES else (size + 1) * w.shape[1])
            while a < mine.num_rows:  # so many rows that their products fit
                b = a + max(1, int(np.searchsorted(cost[a:] - (cost[a - 1] if a else 0), AT_ONCE)))
                b = min(b, mine.num_rows)
                some, start, slot, value = mine.slice(a, b - a), edge[a:b + 1] - edge[a], slots[edge[a]:edge[b]], values[edge[a]:edge[b]]
                z = logits_of(w, start, slot, value)
                kept = {c: some.column(c) for c in ("kind", "task", "split", "id", "label_idx", "epoch", "step")}
                flat = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel()))
                yield rows(len(z), logits=flat, **kept)
                train = some.column("kind").to_numpy(zero_copy_only=False) == "train"
                if train.any():
                    each = np.diff(start)
                    take, at = np.repeat(train, each), np.concatenate([[0], np.cumsum(each[train])])
                    label = some.column("label_idx").to_numpy(zero_copy_only=False)[train].astype(np.int64)
                    if task not in grads:
                        grads[task] = room({task: w.shape[1]}, len(w) - 1)[task]
                    add_gradient(grads[task], z[train], label, at, slot[take], value[take])
                    seen[task] = seen.get(task, 0) + int(train.sum())
                a = b
        for task, g in grads.items():
            runs = run_of(g.shape[1])
            starts = [a for a in range(0, len(g), runs) if g[a:a + runs].any()]
            per = max(1, AT_ONCE // (runs * g.shape[1]))
            for some in (starts[i:i + per] for i in range(0, len(starts), per)):
                parts = [g[a:a + runs].ravel() for a in some]
                flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), pa.array(np.concatenate(parts)))
                yield rows(len(some), kind=pa.repeat("grad", len(some)), task=pa.repeat(task, len(some)), slot=pa.array(some, pa.int32()), grad=flat)
            yield rows(1, kind=pa.array(["grad"]), task=pa.array([task]), slot=pa.array([-1], pa.int32()), grad=pa.array([[float(seen[task])]]))


def scored(rows: DataFrame, heads: dict[str, np.ndarray]) -> DataFrame:
    """``PASS`` rows of ``rows`` (``kind``: train, dev or other; keys, ``slot`` and ``value``, or instead of them ``packed`` counts), and the
    gradients of the train rows."""
    ship_package(rows.sparkSession)
    held = Held(rows.sparkSession, heads)
    cols = ("kind", "task", "split", "id", "label_idx", "epoch", "step", "slot", "value", *(["packed"] if "packed" in rows.columns else []))
    return rows.select(*cols).mapInArrow(lambda batches: Pass(held)(batches), PASS)


def _numbers(df: DataFrame, cells: int) -> Iterator[tuple[str, int, np.ndarray]]:
    """(task, slot, numbers) of all rows of ``df``, fetched at once if they are at most ``MAX_CELLS``, else one partition after the other."""
    if cells > MAX_CELLS:
        for task, slot, numbers in df.toLocalIterator():
            yield task, slot, np.array(numbers)
        return
    got = df.toArrow()
    for task, slot, numbers in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2), strict=True):
        yield task, slot, numbers.values.to_numpy()


def mean_gradient(passed: DataFrame, classes: dict[str, int], slots: int) -> dict[str, np.ndarray]:
    """The gradients of a pass merged by (task, run of slots), divided by the task's rows; fetched, as their size is that of the heads."""
    grads = passed.filter("kind = 'grad'").select("task", "slot", array_to_vector(F.col("grad")).alias("g"))
    merged = grads.groupBy("task", "slot").agg(vector_to_array(Summarizer.sum(F.col("g"))).alias("g"))
    out, n = room(classes, slots), {}
    for task, slot, g in _numbers(merged, cells_of(classes, slots)):
        if slot < 0:
            n[task] = g[0]
        else:
            g = g.reshape(-1, classes[task])
            out[task][slot:slot + len(g)] = g
    for task, rows in n.items():
        out[task] /= rows
    return out


def state_table(spark: SparkSession, heads: dict[str, np.ndarray], moves: dict[str, np.ndarray]) -> DataFrame:
    """(``task``, ``slot``, ``weights``, ``move``) of all slots that have moved."""
    schema = "task string, slot int, weights array<double>, move array<double>"
    if cells_of({t: w.shape[1] for t, w in heads.items()}, max((len(w) for w in heads.values()), default=1) - 1) > MAX_CELLS:
        return _mapped_state(spark, heads, moves, schema)
    parts = [_state_rows(task, w, moves[task], 0) for task, w in heads.items()]
    return spark.createDataFrame(pa.concat_tables(parts), schema).coalesce(1) if parts else spark.createDataFrame([], schema)


def _state_rows(task: str, w: np.ndarray, move: np.ndarray, first: int) -> pa.Table:
    some = np.flatnonzero(w.any(axis=1) | move.any(axis=1))
    edge = np.arange(len(some) + 1, dtype=np.int32) * w.shape[1]
    return pa.table({"task": pa.repeat(task, len(some)), "slot": pa.array(some + first, pa.int32()),
                     **{n: pa.ListArray.from_arrays(edge, pa.array(x[some].ravel())) for n, x in (("weights", w), ("move", move))}})


def _mapped_state(spark: SparkSession, heads: dict[str, np.ndarray], moves: dict[str, np.ndarray], schema: str) -> DataFrame:
    """``state_table`` of heads that are mapped: their rows are read from the file by the workers."""
    ship_package(spark)
    held, last = Held(spark, heads), Held(spark, moves)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = held.heads(), last.heads()
        for batch in batches:
            slot = batch.column("id").to_numpy()
            for task in w if len(slot) else ():
                step = step_of(w[task])
                for a in range(int(slot[0]), int(slot[-1]) + 1, step):  # a batch of a range is without gaps
                    at = slice(a, min(a + step, int(slot[-1]) + 1))
                    yield from _state_rows(task, w[task][at], m[task][at], a).to_batches()

    return spark.range(held.slots + 1).mapInArrow(read, schema)


def fetched(state: DataFrame, classes: dict[str, int], slots: int, column: str = "weights") -> dict[str, np.ndarray]:
    """Stored heads (or ``move``) as matrices."""
    heads = room(classes, slots)
    for task, slot, numbers in _numbers(state.select("task", "slot", column), cells_of(classes, slots)):
        heads[task][slot] = numbers
    return heads


def moved(heads: dict[str, np.ndarray], moves: dict[str, np.ndarray], grad: dict[str, np.ndarray], rate: float, momentum: float):
    """(heads, moves) after a step."""
    classes, slots = {t: w.shape[1] for t, w in heads.items()}, max((len(w) for w in heads.values()), default=1) - 1
    after, by = room(classes, slots), room(classes, slots)
    for t, w in heads.items():
        for a in range(0, len(w), step_of(w)):
            at = slice(a, a + step_of(w))
            by[t][at] = momentum * moves[t][at] - rate * grad[t][at]
            after[t][at] = w[at] + by[t][at]
    return after, by


def train(blocks, dev: DataFrame, classes: dict[str, int], slots: int, keep, rate: float = RATE, momentum: float = MOMENTUM,
          state: DataFrame | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Fits the heads over ``blocks`` (one frame of train rows with ``slot`` and ``value`` per block, in order), from nothing
    or from a stored ``state``.

    Returns (passes, states): pass k has block k's rows and, from the second on, the ``dev`` rows, scored by the heads before
    block k; state k the heads after it.  ``keep``: writes a frame (partitioned by some columns) and reads it again."""
    zero = room(classes, slots)
    heads = fetched(state, classes, slots) if state is not None else zero
    moves = fetched(state, classes, slots, "move") if state is not None else zero
    passes, states = [], []
    for k, rows in enumerate(blocks):
        both = rows.unionByName(dev) if k or state is not None else rows
        passes.append(keep(scored(both, heads), ("kind",)))
        grad = mean_gradient(passes[-1], classes, slots)
        heads, moves = moved(heads, moves, grad, rate, momentum)
        states.append(keep(state_table(dev.sparkSession, heads, moves), ()))
    return passes, states
