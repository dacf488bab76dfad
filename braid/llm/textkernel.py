"""Vectorised hashing of words and word shingles over whole texts.

All functions work on a flat byte buffer that holds many UTF-8 texts and the
offsets that bound them, so the cost is a few array passes and not a Python
loop per word.  A word is a run of bytes other than space and the control
characters from tab to carriage return.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240607)
# A random 64-bit number per byte value and per shingle place, and an odd base
# for the polynomial hash (odd numbers have an inverse modulo 2**64).
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_LOWER = BYTE[LOWER]

MOST_KEPT = 1 << 21
_powers: dict[str, np.ndarray] = {}


def _power(base, n: int, name: str) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (kept for later calls, up to ``MOST_KEPT``)."""
    p = _powers.get(name)
    if p is None or len(p) <= n:
        p = np.full(max(n + 1, 1 << 16), base, U)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if len(p) <= MOST_KEPT:
            _powers[name] = p
    return p[:n + 1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(buf: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """P with P[i] the polynomial sum over buf[:i]; see ``span_hash``."""
    p = np.empty(len(buf) + 1, U)
    p[0] = 0
    np.cumsum(table[buf] * _power(BASE, len(buf), "base")[:len(buf)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal byte strings, equal hashes."""
    inv = _power(INVERSE, len(p) - 1, "inverse")
    return mix64((p[end] - p[start]) * inv[start] + (end - start).astype(U))


def words(buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in order, and the index of the first word of
    each text (one more entry than texts).  ``breaks``: the bytes between words."""
    inside = ~breaks[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and the first index of each
    text (one more entry than texts).  A text with fewer words, but some, has
    its whole sequence as one shingle."""
    start, end, at = words(buf, offs)
    n = len(start)
    w = span_hash(prefix_hash(buf, BYTE_LOWER if lower else BYTE), start, end)
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    i = np.arange(n)
    left = at[1:][text] - i  # words from here to the end of the text
    h = np.zeros(n, U)
    for j in range(min(k, n)):
        part = w[j:] * PLACE[j]
        if j:
            part = np.where(left[:n - j] > j, part, U(0))
        h[:n - j] += part
    short = (count[text] < k) & (i == at[:-1][text])
    h[short] += U(0x51ED270B) * count[text][short].astype(U)
    keep = (left >= k) | short
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return mix64(h[keep]), np.concatenate([[0], np.cumsum(sizes)])


def distinct_sorted(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the values of each text and drops repeats; (values, first index)."""
    h = h.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[at[:-1][at[:-1] < len(h)]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[at]
