"""Tokens and framed sequences of lower-cased texts in Arrow batches.

A batch's texts are one run of bytes.  Every character is looked up in a table of kinds - white space, part of a run of letters and
digits, token of its own - and tokens are cut where the kinds say so; the bytes that are left are the tokens, end to end.  The table has all
code points as the JVM's regex classes have them (``text.JVM_PATTERN``), so the tokens are those of ``text.tokenize``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import TASKS

SPACE, RUN, OWN = 0, 1, 2
# Bytes of text taken at a time.
PIECE = 1 << 20

# The kinds by which tokens joined by spaces are taken apart.
JOINED = np.full(0x110000, RUN, np.uint8)
JOINED[32] = SPACE

_kinds: dict[str, object] = {}


def kinds(spark: SparkSession):
    """Broadcast: the kind of each code point, asked of the JVM once per application."""
    key = spark.sparkContext.applicationId
    if key not in _kinds:
        # A byte order mark of its own goes first, so that the character of that code is kept.
        char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")
        kind = (F.when(char.rlike(r"[\x{4E00}-\x{9FFF}]"), OWN).when(char.rlike(r"[\p{L}\p{N}]"), RUN)
                .when(char.rlike(r"\s"), SPACE).otherwise(OWN))
        got = spark.range(0x110000).filter("id < 55296 OR id > 57343").select("id", kind.cast("tinyint").alias("k")).toArrow()
        table = np.full(0x110000, OWN, np.uint8)
        table[got["id"].to_numpy()] = got["k"].to_numpy()
        _kinds[key] = spark.sparkContext.broadcast(table.tobytes())
    return _kinds[key]


def _kinds_of(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of the character that each byte of UTF-8 ``data`` is part of, and whether the byte begins it."""
    kind, begins = table[data], (data & 0xC0) != 0x80
    for lead, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero(data >= lead if size == 4 else (data >= lead) & (data < lead + (0x20 >> size - 2)))
        if len(at):
            code = (data[at] - lead).astype(np.int64)
            for k in range(1, size):
                code = code << 6 | data[at + k] & 0x3F
            own = table[code]
            for k in range(size):
                kind[at + k] = own
    return kind, begins


def tokens_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, one after the other, and their number in each (null: none)."""
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edge = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0]:edge[-1]]
    edge = edge.astype(np.int64) - edge[0]
    left, starts, at, size, a, last = [], [], [], 0, 0, False
    while a < len(data):
        b = min(a + PIECE, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:  # a character stays whole
            b += 1
        kind, begins = _kinds_of(data[a:b], table)
        run = kind == RUN
        on = run.copy()  # goes on with the token before
        on[1:] &= run[:-1]
        on[0] &= last
        on[edge[np.searchsorted(edge, a):np.searchsorted(edge, b)] - a] = False  # a text begins
        kept = kind != SPACE
        first = kept & begins & ~on
        left.append(data[a:b][kept])
        at.append(np.flatnonzero(first) + a)
        starts.append(np.flatnonzero(first[kept]) + size)
        size, a, last = size + len(left[-1]), b, run[-1]
    offsets = np.concatenate([*starts, [size]]).astype(np.int32)
    joined = np.concatenate([*left, np.empty(0, np.uint8)])
    tokens = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(joined))
    return tokens, np.diff(np.searchsorted(np.concatenate([*at, np.empty(0, np.int64)]), edge))


def _head_tail(n: np.ndarray, limit) -> tuple[np.ndarray, np.ndarray]:
    """Tokens ``text.head_tail`` keeps of the head and of the tail."""
    return np.where(n <= limit, n, limit // 2), np.where(n <= limit, 0, limit - limit // 2)


def trimmed(la: np.ndarray, lb: np.ndarray, max_len: int, max_a: int, max_b: int):
    """Tokens ``text.trim_pair`` keeps: (head, tail) of a and of b."""
    m = max_len - 3
    cases = [la + lb + 3 <= max_len, (lb >= max_b) & (la >= max_a), (la <= lb) & (la < max_a), (lb < la) & (lb <= max_b)]
    none = np.zeros_like(la)
    lfa = np.where(la + lb > m, np.minimum(la, np.maximum(-(-m // 2), m - lb)), la)
    lfb = np.where(la + lb > m, np.minimum(lb, np.maximum(m // 2, m - la)), lb)
    a = [(la, none), _head_tail(la, max_a), (la, none), _head_tail(la, max_a + (max_b - lb - 1))]
    b = [(lb, none), _head_tail(lb, max_b), _head_tail(lb, max_b + (max_a - la - 1)), (lb, none)]
    pick = lambda some, i, rest: np.select(cases, [x[i] for x in some], rest)
    return (pick(a, 0, lfa), pick(a, 1, none)), (pick(b, 0, lfb), pick(b, 1, none))


def framed(task: pa.Array, a: tuple[pa.Array, np.ndarray], b: tuple[pa.Array, np.ndarray]) -> dict[str, pa.Array]:
    """``features.sequences`` of rows with the tokens ``a`` and ``b`` (tokens and their number in each row)."""
    (ta, la), (tb, lb) = a, b
    words = pa.concat_arrays([ta, tb, pa.array(["[CLS]", "[SEP]"])])
    cls, sep = len(words) - 2, len(words) - 1
    names = np.asarray(task.to_pylist(), object)
    n, none = len(names), np.zeros(len(names), np.int64)
    heads, tails, max_length, known, pair = [none.copy(), none.copy()], [none.copy(), none.copy()], none.copy(), none > 0, none > 0
    for spec in TASKS:
        own = np.flatnonzero(names == spec.name)
        if spec.kind == "single":
            sides = [(np.minimum(la[own], max(0, spec.max_length - 2)), none[own]), (none[own], none[own])]
        else:
            sides = trimmed(la[own], lb[own], spec.max_length, spec.max_a, spec.max_b)
            pair[own] = True
        for k, (head, tail) in enumerate(sides):
            heads[k][own], tails[k][own] = head, tail
        max_length[own], known[own] = spec.max_length, True
    start_a, start_b = np.cumsum(la) - la, np.cumsum(lb) - lb + len(ta)
    one = known.astype(np.int64)
    starts = np.stack([none + cls, start_a, start_a + la - tails[0], none + sep, start_b, start_b + lb - tails[1], none + sep], 1).ravel()
    size = np.stack([one, heads[0], tails[0], one, heads[1], tails[1], pair.astype(np.int64)], 1)
    each, flat = size.sum(axis=1), size.ravel()
    at = np.repeat(starts - (np.cumsum(flat) - flat), flat) + np.arange(flat.sum())
    edge = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
    seq = pa.ListArray.from_arrays(edge, words.take(pa.array(at)), mask=pa.array(~known))
    whole = lambda x: pa.array(x.astype(np.int32), mask=~known)
    missing = np.array([t is None for t in names], bool)
    return {"seq": seq, "len_a": whole(heads[0] + tails[0]), "len_b": whole(heads[1] + tails[1]), "max_length": whole(max_length),
            "is_pair": pa.array(pair, mask=missing)} if n else {
        "seq": pa.array([], pa.list_(pa.string())), "len_a": pa.array([], pa.int32()), "len_b": pa.array([], pa.int32()),
        "max_length": pa.array([], pa.int32()), "is_pair": pa.array([], pa.bool_())}


FRAMED = "seq array<string>, len_a int, len_b int, max_length int, is_pair boolean"


def frame_batches(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with lower-cased ``text_a`` and ``text_b``: the sequences instead of the texts."""
    for whole in batches:
        kept = [c for c in whole.schema.names if c not in ("text_a", "text_b")]
        out = framed(whole.column("task"), tokens_of(whole.column("text_a"), table), tokens_of(whole.column("text_b"), table))
        yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in kept), *out.values()], names=[*kept, *out])
