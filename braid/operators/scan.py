"""Running values and lags over long ordered tables, block by block.

A window over a whole run, task or epoch is one task however long the log is.  Here the order (an
integer column) is cut into blocks of ``BLOCK``: values run inside a block, and what all earlier blocks add up
to is carried in.  The carries are a running value over one row per block, found the same way.  A lag needs the last rows of the block
before; those are copied into the next block, so no block waits for another and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
# How a running value of each kind takes in what was before; nulls count for nothing.
_MERGE = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest}
_AGG = {"sum": F.sum, "max": F.max}


def block_of(order: str, block: int) -> Column:
    return F.call_function("div", F.col(order), F.lit(block).cast("bigint"))


def running(df: DataFrame, part: list[str], order: str, values: dict[str, tuple[str, str]], largest: int | None = None,
            block: int = BLOCK, before: bool = False) -> DataFrame:
    """Adds, per row, running values within ``part`` by ``order`` (integers from 0, each once in its part; gaps do no
    harm).  ``values``: new column -> ("sum" or "max", column).  ``before``: without the row itself (null for the first).
    ``largest``: the largest ``order``, if known."""
    if largest is None:
        largest = df.agg(F.max(order)).first()[0] or 0
    d = df.withColumn("_block", block_of(order, block))
    here = Window.partitionBy(*part, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = d.withColumns({name: _AGG[how](col).over(here) for name, (how, col) in values.items()})
    if largest >= block:
        sums = d.groupBy(*part, F.col("_block").alias("_at")).agg(
            *[_AGG[how](col).alias(f"_t_{name}") for name, (how, col) in values.items()])
        carry = running(sums, part, "_at", {f"_c_{name}": (how, f"_t_{name}") for name, (how, _) in values.items()},
                        largest // block, block, before=True)
        carry = carry.select(*part, F.col("_at").alias("_block"), *[f"_c_{name}" for name in values])
        out = out.join(carry, [*part, "_block"]).withColumns(
            {name: _MERGE[how](F.col(name), F.col(f"_c_{name}")) for name, (how, _) in values.items()})
    return out.select(*df.columns, *values)


def place(df: DataFrame, part: list[str], outer: str, inner: str, out: str, largest: tuple[int, int] | None = None,
          block: int = BLOCK) -> DataFrame:
    """Adds ``out``, the row's place (from 1, without gaps) within ``part`` by (``outer``, ``inner``)."""
    if largest is None:
        largest = tuple(x or 0 for x in df.agg(F.max(outer), F.max(inner)).first())
    sizes = df.groupBy(*part, outer).agg(F.count(F.lit(1)).alias("_n"))
    earlier = running(sizes, part, outer, {"_earlier": ("sum", "_n")}, largest[0], block, before=True)
    inside = running(df.withColumn("_one", F.lit(1).cast("bigint")), [*part, outer], inner, {"_at": ("sum", "_one")}, largest[1], block)
    return (inside.join(earlier.select(*part, outer, "_earlier"), [*part, outer])
            .withColumn(out, F.coalesce("_earlier", F.lit(0)) + F.col("_at")).select(*df.columns, out))


def lagged(df: DataFrame, part: list[str], order: str, values: dict[str, tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """Adds lags within ``part``.  ``order``: a place without gaps; ``values``: new column -> (column, rows back)."""
    far = max(back for _, back in values.values())
    own = block_of(order, block)
    # The last rows of a block are also the first ones of the next.
    blocks = F.when(F.col(order) % block >= block - far, F.array(own, own + 1)).otherwise(F.array(own))
    d = df.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*part, "_block").orderBy(order)
    return (d.withColumns({name: F.lag(col, back).over(w) for name, (col, back) in values.items()})
            .filter(F.col("_block") == F.col("_own")).select(*df.columns, *values))
