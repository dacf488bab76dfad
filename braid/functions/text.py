"""Column expressions for tokenising, trimming and encoding.

Everything is a built-in Spark expression (regexp, slice, concat,
array_repeat, least/greatest), so it runs inside the JVM; there is no Python
UDF.  Only ``joined`` uses a higher-order function, which Spark evaluates
outside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens of ``config.TOKEN_PATTERN``.  Java runs a group of alternatives step by step, so letters and digits that are no
# ideographs are one character class here.
JVM_PATTERN = r"[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]++|[^\s\p{L}\p{N}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _i(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def tokenize(text) -> Column:
    """G1: lower-case, then one token per CJK ideograph, per letter/digit run
    and per punctuation mark.  Null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(JVM_PATTERN), 0),
                      F.array().cast("array<string>"))


def head_tail(tokens, limit) -> Column:
    """Keep the first ``limit // 2`` and the last ``limit - limit // 2``
    tokens; the whole list when it already fits (never duplicates)."""
    t, L = _c(tokens), _i(limit)
    n = F.size(t)
    h = F.floor(L / 2).cast("int")
    tail = (L - h).cast("int")
    # n > L >= tail here, so the tail start n - tail + 1 is >= 1 (a start of
    # n + 1 with tail 0 yields an empty slice).
    cut = F.concat(F.slice(t, 1, h), F.slice(t, n - tail + 1, tail))
    return F.when(n <= L, t).otherwise(cut)


def longest_first_lengths(la, lb, m):
    """Lengths left by popping from the longer list (ties pop b) until
    ``la + lb <= m``.  Closed form: a' = min(la, max(ceil(m/2), m - lb)),
    b' = min(lb, max(floor(m/2), m - la))."""
    la, lb, m = _i(la), _i(lb), _i(m)
    over = (la + lb) > m
    a2 = F.least(la, F.greatest(F.ceil(m / 2).cast("int"), m - lb))
    b2 = F.least(lb, F.greatest(F.floor(m / 2).cast("int"), m - la))
    return F.when(over, a2).otherwise(la), F.when(over, b2).otherwise(lb)


def trim_pair(a, b, max_len: int, max_a: int, max_b: int):
    """head+tail pair trim; returns (a', b') token arrays.

    1. both sides at or above their limits -> each side head+tail to its limit;
    2. a shorter than b and below its limit -> b's limit grows by
       ``max_a - len(a) - 1``;
    3. b shorter than a (and within its limit) -> a's limit grows by
       ``max_b - len(b) - 1``;
    4. otherwise longest-first to ``max_len - 3``.
    Nothing happens when ``len(a) + len(b) + 3 <= max_len``.
    """
    a, b = _c(a), _c(b)
    la, lb = F.size(a), F.size(b)
    fits = la + lb + 3 <= max_len
    c1 = (lb >= max_b) & (la >= max_a)
    c2 = (la <= lb) & (la < max_a)
    c3 = (lb < la) & (lb <= max_b)
    grow_b = F.lit(max_b) + (F.lit(max_a) - la - 1)
    grow_a = F.lit(max_a) + (F.lit(max_b) - lb - 1)
    lfa, lfb = longest_first_lengths(la, lb, max_len - 3)
    a_out = (F.when(fits, a).when(c1, head_tail(a, max_a)).when(c2, a)
             .when(c3, head_tail(a, grow_a)).otherwise(F.slice(a, 1, lfa)))
    b_out = (F.when(fits, b).when(c1, head_tail(b, max_b)).when(c2, head_tail(b, grow_b))
             .when(c3, b).otherwise(F.slice(b, 1, lfb)))
    return a_out, b_out


def _rep(v: int, n) -> Column:
    return F.array_repeat(F.lit(v), F.greatest(_i(n), F.lit(0)).cast("int"))


def single_sequence(tokens, max_len: int) -> Column:
    """``[CLS] + first max_len-2 tokens + [SEP]`` as strings."""
    return F.concat(F.array(F.lit("[CLS]")), F.slice(_c(tokens), 1, max_len - 2), F.array(F.lit("[SEP]")))


def pair_sequence(a, b) -> Column:
    """``[CLS] a [SEP] b [SEP]`` as strings (a, b already trimmed)."""
    return F.concat(F.array(F.lit("[CLS]")), _c(a), F.array(F.lit("[SEP]")), _c(b), F.array(F.lit("[SEP]")))


def attention_mask(n_real, max_len) -> Column:
    """``1`` for each real position, ``0`` for padding."""
    return F.concat(_rep(1, n_real), _rep(0, _i(max_len) - _i(n_real)))


def segment_ids(len_a, len_b, max_len, is_pair) -> Column:
    """0 for ``[CLS] a [SEP]``, 1 for ``b [SEP]``, 0 for padding; all 0
    for single texts."""
    la, lb, m = _i(len_a), _i(len_b), _i(max_len)
    pair = F.concat(_rep(0, la + 2), _rep(1, lb + 1), _rep(0, m - la - lb - 3))
    return F.when(_i(is_pair), pair).otherwise(_rep(0, m))


def pad_ids(ids, max_len, pad_id: int = 0) -> Column:
    """Right-pad an id array with ``pad_id`` to ``max_len``."""
    return F.concat(_c(ids), _rep(pad_id, _i(max_len) - F.size(_c(ids))))


def joined(arr) -> Column:
    """Array -> space-separated string (cross-engine comparison form)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), " ")
