"""Array column kit (G11-G15 and vector helpers).

Higher-order built-ins (``transform``, ``aggregate``, ``zip_with``) keep the
per-row vector math inside the JVM; nothing here needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a lambda-bound
    variable), so expressions that use their input several times do not
    copy the input expression into the plan."""
    return F.element_at(F.transform(F.array(_c(value)), fn), 1)


def argmax(arr) -> Column:
    """0-based index of the largest element; the first one on ties."""
    return let(arr, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def total(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def softmax(arr) -> Column:
    """Max-shifted softmax."""
    def f(a):
        e0 = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
        return let(e0, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))
    return let(arr, f)


def log_softmax(arr) -> Column:
    def f(a):
        lse = let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))))
        return let(lse, lambda c: F.transform(a, lambda x: x - c))
    return let(arr, f)


def one_hot(idx, n_classes) -> Column:
    """``[0.0 .. 1.0 .. 0.0]`` of length ``n_classes``."""
    i = _c(idx)
    n = n_classes if isinstance(n_classes, Column) else F.lit(n_classes)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def masked_len(mask) -> Column:
    """Number of real positions (sum of a 0/1 mask)."""
    return F.aggregate(_c(mask), F.lit(0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def sumsq(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2(arr) -> Column:
    """Euclidean norm."""
    return F.sqrt(sumsq(arr))


def scale(arr, k) -> Column:
    kk = k if isinstance(k, Column) else F.lit(k)
    return F.transform(_c(arr), lambda x: x * kk)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def normalize(arr, floor: float = 0.0) -> Column:
    """``x / max(||x||, floor)``; a zero vector stays zero."""
    return let(arr, lambda a: let(F.greatest(l2(a), F.lit(floor)), lambda n: F.transform(
        a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def lit_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def lit_matrix(rows) -> Column:
    return F.array(*[lit_vector(r) for r in rows])


def joined(arr, digits: int = 6) -> Column:
    """Rounded, space-joined form for cross-engine comparison."""
    return F.array_join(F.transform(_c(arr), lambda x: F.round(x, digits).cast("string")), " ")
