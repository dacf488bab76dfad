"""Naive Bayes counts and scores of counted rows in Arrow batches.

A batch's tokens are dictionary-encoded.  For the fit, those of a task and label are added up before they become rows.  For the scores, the
workers hold the model rows of hot tokens: each different token is looked up once, and a row's sum over its hot tokens is made where the row
is read; the others are passed on as the row's ``cold`` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import tokens as tk

# Numbers held at a time: tokens of a few rows times classes.
AT_ONCE = 1 << 20
TOTALS = "task string, token string, label_idx int, cnt bigint"
SUMS = "task string, split string, id bigint, label_idx int, hot array<double>, cold array<struct<token: string, cnt: int>>"


def by_task(model: pa.Table) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Tokens and log likelihoods (token x class) of each task of a model (``task``, ``token``, ``ll``)."""
    out = {}
    for task in model["task"].unique().to_pylist():
        mine = model.filter(pc.equal(model["task"], task)).combine_chunks()
        out[task] = mine["token"].combine_chunks().cast(pa.string()), mine["ll"].combine_chunks().flatten().to_numpy().reshape(mine.num_rows, -1).copy(order="F")
    return out


def total_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, task and label: how often each token is there."""
    for whole in batches:
        for task in whole.column("task").unique().to_pylist():
            mine = whole.filter(pc.equal(whole.column("task"), task))
            words, size = tk.tokens_of(mine.column("tokens"), tk.JOINED)
            words, label = words.dictionary_encode(), mine.column("label_idx").fill_null(-1).to_numpy().astype(np.int64)
            most = int(label.max(initial=-1)) + 2  # labels from -1, that is none, on
            pair, where = np.unique(words.indices.to_numpy().astype(np.int64) * most + np.repeat(label, size) + 1, return_inverse=True)
            cnt = np.bincount(where, mine.column("times").flatten().to_numpy(), len(pair)).astype(np.int64)
            code, label = np.divmod(pair, most)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(task, len(pair)), words.dictionary.take(pa.array(code)), pa.array((label - 1).astype(np.int32), mask=label == 0),
                 pa.array(cnt)], names=["task", "token", "label_idx", "cnt"])


def row_sums(known: tuple[pa.Array, np.ndarray] | None, joined: pa.Array, times: np.ndarray, classes: int) -> tuple[np.ndarray, pa.ListArray]:
    """For each row of ``joined`` tokens (``times``: how often each is there) the sum over those that are ``known``, and the others."""
    flat, size = tk.tokens_of(joined, tk.JOINED)
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    hot, at = np.zeros((len(size), classes)), np.full(len(flat), -1)
    if known is not None and len(flat):
        words = flat.dictionary_encode()
        found = pc.index_in(words.dictionary, value_set=known[0]).fill_null(-1).to_numpy().astype(np.int64)
        at = found[words.indices.to_numpy()]
        mine = np.flatnonzero(at >= 0)
        inside = np.searchsorted(mine, edge)  # places of the rows among the known tokens
        a = 0
        while a < len(size):  # so many rows that their products fit
            b = a + max(1, int(np.searchsorted(inside[a + 1:] - inside[a], AT_ONCE // max(1, classes), "right")))
            full = a + np.flatnonzero(np.diff(inside[a:b + 1]))
            if len(full):
                some = mine[inside[a]:inside[b]]
                first, cnt, own = inside[full] - inside[a], times[some], at[some]
                for k in range(known[1].shape[1]):
                    hot[full, k] = np.add.reduceat(cnt * known[1][:, k][own], first)
            a = b
    rest = np.flatnonzero(at < 0)
    cold = pa.StructArray.from_arrays([flat.take(pa.array(rest)), pa.array(times[rest].astype(np.int32))], names=["token", "cnt"])
    return hot, pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, edge).astype(np.int32)), cold)


def sum_batches(batches: Iterator[pa.RecordBatch], model: dict, classes: int) -> Iterator[pa.RecordBatch]:
    keys = ["task", "split", "id", "label_idx"]
    for whole in batches:
        for task in whole.column("task").unique().to_pylist():
            mine = whole.filter(pc.equal(whole.column("task"), task))
            hot, cold = row_sums(model.get(task), mine.column("tokens"), mine.column("times").flatten().to_numpy(), classes)
            flat = pa.ListArray.from_arrays(np.arange(len(hot) + 1, dtype=np.int32) * classes, pa.array(hot.ravel()))
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in keys), flat, cold], names=[*keys, "hot", "cold"])
