"""Hashed token n-grams of a row (H4).

The pass is Arrow batches: every n-gram of every size is hashed, some thousand at a time, and a row's buckets are its different
hashes; nothing is shuffled.  An n-gram's bucket is the number of the first 8 hex digits of the md5 of its tokens, joined by a space,
mod ``buckets``.  One md5 object for each n-gram takes longer than the hash, so md5 (RFC 1321) runs here on columns of numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# N-grams hashed together, and the 64-byte blocks up to which they are: longer ones are hashed singly.
TOGETHER, MOST_BLOCKS = 16_384, 4
# Bytes of tokens between Spark and a Python worker at a time.
BATCH_BYTES = 16 << 20

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = (np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2**32).astype(np.uint64).astype(np.uint32)
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def md5_heads(words: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of each padded message (a row of 16 words for each of its blocks)."""
    state = [np.full(len(words), x, np.uint32) for x in _START]
    f, t = np.empty_like(state[0]), np.empty_like(state[0])
    words = np.ascontiguousarray(words.T)
    for block in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                at = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                at = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                at = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                at = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _ADD[i]
            f += words[block + at]
            turn = _TURN[i // 16][i % 4]
            np.left_shift(f, turn, out=t)
            f >>= 32 - turn
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        for kept, x in zip(state, (a, b, c, d), strict=True):
            kept += x
    return state[0].byteswap()


def hashes(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``md5_heads`` of pieces of ``text``, which ends in ``64 * MOST_BLOCKS`` bytes more than its pieces need."""
    out = np.empty(len(start), np.uint32)
    blocks = (length + 72) // 64  # with the closing bit and eight bytes of length
    for b in range(1, MOST_BLOCKS + 1):
        which = np.flatnonzero(blocks == b)
        if len(which):
            n = length[which]
            m = np.lib.stride_tricks.sliding_window_view(text, 64 * b)[start[which]]
            m *= np.arange(64 * b, dtype=np.int32) < n[:, None]
            m[np.arange(len(which)), n] = 0x80
            words = m.view("<u4")
            words[:, -2] = n * 8
            out[which] = md5_heads(words)
    for i in np.flatnonzero(blocks > MOST_BLOCKS):
        out[i] = int(hashlib.md5(text[start[i]:start[i] + length[i]]).hexdigest()[:8], 16)
    return out


def buckets_of(tokens: pa.ListArray, sizes: tuple[int, ...], buckets: int) -> list[pa.ListArray]:
    """For each size, the different buckets of each row's n-grams, ascending."""
    size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size), dtype=np.int64), size)
    # Every token with a space behind it: an n-gram is a piece of this text.
    nothing, space = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    spaced = pc.binary_join_element_wise(tokens.flatten().cast(pa.large_binary()), nothing, space)
    edge = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy())])
    text = np.frombuffer(b"".join([spaced.buffers()[2] or b"", bytes(64 * MOST_BLOCKS)]), np.uint8)
    out = []
    for n in sizes:
        first = np.flatnonzero(row[:max(0, len(row) - n + 1)] == row[n - 1:])
        keys = [np.empty(0, np.int64)]
        for lo in range(0, len(first), TOGETHER):
            at = first[lo:lo + TOGETHER]
            start = edge[at]
            found = hashes(text, start, (edge[at + n] - 1 - start).astype(np.int32)).astype(np.int64)
            keys.append(np.unique(row[at] * buckets + found % buckets))
        where, bucket = np.divmod(np.unique(np.concatenate(keys)), buckets)
        ends = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(size)))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(ends, bucket))
    return out


def bucket_batches(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """``_tokens`` of each batch replaced by ``b{n}`` for each size."""
    for whole in batches:
        kept = [c for c in whole.schema.names if c != "_tokens"]
        found = buckets_of(whole.column("_tokens"), sizes, buckets)
        yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in kept), *found], names=[*kept, *(f"b{n}" for n in sizes)])
