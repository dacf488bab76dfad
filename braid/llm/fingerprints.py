"""Document fingerprints by consistent weighted sampling.

The terms of a text are its five-word shingles (lower-cased A-Z), weighted by
how often they occur.  For every sample each term has two Gamma(2, 1) numbers r
and c and a uniform beta; a term of weight w has t = floor(ln w / r + beta) and
the value c / exp(r * (t - beta + 1)).  The sample of a text is the (term, t)
with the smallest value, so two texts agree in a sample with a probability
equal to their generalised Jaccard similarity (sum of the smaller over sum of
the larger weights).

The numbers come from tables of ``ROWS`` rows; a term's row differs per group
of samples and terms that share a row are ordered by their own hash, which
keeps the order of the terms uniformly random.  A term of weight 1 has t = 0,
so its value is looked up and only repeated terms are computed.

Defined results.  Null text: empty.  A text with fewer than five words, but
some, has one term; texts without words have the same fingerprint of their own.
Equal texts have equal fingerprints whatever the rows around them.  Extra
columns are ignored.  An empty table gives an empty result.  ``with_next``
orders by id, equal ids by text, null ids last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, ship_package
from .textkernel import PLACE, mix64, shingles

WORDS = 5
SAMPLES = 128  # 1024 at most: 64 groups
GROUP = 16
ROWS = 1 << 15
SEED = 71
ROWS_PER_BLOCK, MOST_BLOCKS = 2048, 20_000
# Bytes of text that are fingerprinted at once.
CHUNK = 1 << 20

_tables: dict[str, np.ndarray] = {}


def _draws() -> dict[str, np.ndarray]:
    """Tables of r, ln c and beta, and the value of weight 1 as sortable high bits."""
    if not _tables:
        g = np.random.default_rng(SEED)
        r, c = g.gamma(2.0, 1.0, (2, GROUP, ROWS))
        beta = g.random((GROUP, ROWS))
        _tables.update(r=r, ln_c=np.log(c), beta=beta, one=_high_bits(np.log(c) - r * (1 - beta)))
    return _tables


def _high_bits(ln_value: np.ndarray) -> np.ndarray:
    """Positive floats order like their bits."""
    return np.exp(ln_value).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)


def _weighted(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of every text, their counts, and the first index of each text."""
    h = h.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[at[:-1][at[:-1] < len(h)]] = True
    where = np.flatnonzero(first)
    return h[where], np.diff(np.append(where, len(h))), np.concatenate([[0], np.cumsum(first)])[at]


def fingerprint(buf: np.ndarray, offs: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples for each text of a flat UTF-8 buffer."""
    h, weight, at = _weighted(*shingles(buf, offs, WORDS))
    n, tab = len(offs) - 1, _draws()
    out = np.full((n, samples), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return out
    starts = at[full]
    often = np.flatnonzero(weight > 1)
    ln_w = np.log(weight[often])
    key = np.empty(len(h), np.uint64)
    for g in range(0, samples, GROUP):
        m = mix64(h ^ PLACE[g // GROUP])
        row, low = (m & np.uint64(ROWS - 1)).astype(np.int64), m >> np.uint64(32)
        some, some_low = row[often], low[often]
        for s in range(min(GROUP, samples - g)):
            np.take(tab["one"][s], row, out=key, mode="clip")
            key |= low
            if len(often):
                r, beta = tab["r"][s][some], tab["beta"][s][some]
                t = np.floor(ln_w / r + beta)
                drawn = mix64(some_low + (t * 2.0**33).astype(np.uint64)) >> np.uint64(32)
                key[often] = (_high_bits(tab["ln_c"][s][some] - r * (t - beta + 1))
                              | np.where(t > 0, drawn, some_low))
            out[full, g + s] = np.minimum.reduceat(key, starts).astype(np.uint16)
    return out


def fingerprint_texts(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """Fingerprints of whole texts, about ``CHUNK`` bytes at a time."""
    out, part, size = [np.empty((0, samples), np.uint16)], [], 0
    for t in [*map(str.encode, texts), None]:
        if part and (t is None or size + len(t) > CHUNK):
            offs = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
            out.append(fingerprint(np.frombuffer(b"".join(part), np.uint8), offs, samples))
            part, size = [], 0
        if t is not None:
            part.append(t)
            size += len(t)
    return np.concatenate(out)


def to_text(prints: np.ndarray) -> list[str]:
    return [p.astype(">u2").tobytes().hex() for p in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def with_next(docs: DataFrame, fn: Callable[[list, list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``fn(ids, texts)`` to runs of documents in ascending id order, the
    last text of each run being only the next document's (after the last
    document: the first), so every document meets its successor once.

    The ids are cut into blocks at quantiles; the first document of a block is
    also sent to the end of the block before, so blocks need nothing else.
    """
    ship_package(docs.sparkSession)
    blocks = min(MOST_BLOCKS, blocks_for(docs.count(), ROWS_PER_BLOCK))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(blocks)], 100_000)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)
    last = max(0, len(cuts) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = np.array([i is None for i in b.column(0).to_pylist()], bool)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            block = np.where(null, last, np.searchsorted(cuts, ids, "right") - 1)
            at = np.minimum(np.searchsorted(cuts, ids), last)
            again = np.flatnonzero(~null & (cuts[at] == ids)) if len(cuts) else np.arange(len(ids))
            rows = np.concatenate([np.arange(len(ids)), again])
            before = np.where(at[again] > 0, at[again] - 1, last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([block, before]).astype(np.int64)),
                 pa.array(np.arange(len(rows)) >= len(ids)),
                 b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))],
                names=["block", "tail", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size, closed = None, [], [], 0, True
        for b in batches:
            for blk, tail, i, t in zip(*(b.column(c).to_pylist() for c in ("block", "tail", "doc_id", "text")),
                                       strict=True):
                if blk != block:
                    block, ids, texts, size, closed = blk, [], [], 0, False
                if closed:  # further rows with the id of the first one
                    continue
                texts.append(t or "")
                if tail:
                    closed = True
                    if ids:
                        yield fn(ids, texts)
                    continue
                if size > CHUNK:
                    yield fn(ids, texts)
                    ids, texts, size = [], texts[-1:], 0
                ids.append(i)
                size += len(texts[-1])

    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        deal, "block long, tail boolean, doc_id long, text string")
    order = ["block", "tail", F.col("doc_id").asc_nulls_last(), "text"]
    return dealt.repartition(blocks, "block").sortWithinPartitions(*order).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (hexadecimal, four digits per sample) of every document."""
    ship_package(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = fingerprint_texts([t or "" for t in b.column(1).to_pylist()], samples)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to_text(prints), pa.string())],
                                             names=["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """For every document: the fingerprint of its text and of the text whose
    last quarter (floor(n / 4) code points) is replaced by the first as many
    code points, or all, of the next document; and how alike the document's
    fingerprint is to the edited text's and to the next document's."""
    import hashlib

    def fn(ids: list, texts: list[str]) -> pa.RecordBatch:
        edited = [a[:len(a) - len(a) // 4] + b[:len(a) // 4] for a, b in zip(texts[:-1], texts[1:], strict=True)]
        own, other = fingerprint_texts(texts), fingerprint_texts(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(to_text(own[:-1]), pa.string()), pa.array(to_text(other), pa.string()),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                   "near_edited", "near_next"])
    return with_next(docs, fn, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                               "edited_fingerprint string, near_edited double, near_next double")
