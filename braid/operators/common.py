"""Small shared helpers: checked broadcast and float quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds on a data-derived table to be broadcast.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

_SMALL: dict[tuple, list] = {}


def checked_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``small`` only after checking its rows and bytes.

    ``small`` is an aggregate (label dictionary, plan, weights, bucket offsets);
    it is written as a stage once (equal plans over equal files share it), so the check and the
    join read it instead of computing it twice.  Above a bound the table is
    returned without a hint and the join is a shuffle join (with AQE skew
    handling).
    """
    from ..plans.stages import materialize
    key = (small.sparkSession.sparkContext.applicationId, small.semanticHash(), tuple(sorted(small.inputFiles())))
    for plan, table, rows, size in _SMALL.setdefault(key, []):
        if plan.sameSemantics(small) and plan.columns == small.columns:
            break
    else:
        table = materialize(small)
        rows, size = table.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
        _SMALL[key].append((small, table, rows, size or 0))
        size = size or 0
    return F.broadcast(table) if rows <= max_rows and size <= max_bytes else table


def r6(c) -> Column:
    """Round to 6 decimals (cross-engine float comparison)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def order_key(id_col, seed, *extra) -> Column:
    """Deterministic, engine-independent pseudo-random order key:
    ``md5(id | seed [| extra...])`` as a 32-char hex string."""
    parts = [F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"),
             F.lit(f"|{seed}")]
    for e in extra:
        parts.append(F.lit("|"))
        parts.append(e.cast("string") if isinstance(e, Column) else F.lit(str(e)))
    return F.md5(F.concat(*parts))
