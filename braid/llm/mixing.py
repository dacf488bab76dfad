"""Mixing sources to target weights by weighted fair queueing.

Every document is one packet of its source's queue, in a shuffled order.  Its
virtual finish time is the number of tokens its source has sent up to its end,
divided by the source's target; a source whose target is above its size is
queued again from the start (up to ``max_repeats`` times).  All packets are
then ordered by finish time and the mix is cut where the total budget is used
up, so every source stops near its target.

Running sums never put a source (one may hold a third of all rows) into one
task: a queue is split by the leading digits of the shuffle key, the pieces are
summed first, and only inside a piece are rows sorted.  The cut works the same
way on ranges of the finish time.  Only ids and sizes are shuffled.

Defined results.  Null text has size 0; a null source is a source of its own,
last in the order; a document of size 0 is never taken.  Repeated rows are
packets of their own (equal ids in one queue follow each other in any order; they have
equal shuffle keys).  Sources without tokens get target 0.  An empty table
gives an empty result.  Other columns are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# A word: a run of anything but space and the control characters from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix-1"
MAX_REPEATS = 3
ROWS_PER_PIECE = 512
# Ranges of the finish time per level, and packets of one range that are ranked at once.
RANGES, RANKED_ROWS = 1024, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: sources by code point, null last, weigh 1, 2, 3, 1, ...
    (one row per source; UTF-8 byte order is code point order)."""
    w = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.row_number().over(w) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]),
                                                     (nth % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target``: shares of all sizes by ``weight``, none above
    ``max_repeats`` times its ``source_size``, the excess reshared by weight.

    In the order of size per weight the sources that reach their limit come
    first, so one pass finds them: a source is limited if the level left to it
    and all after it, once those before have taken their limit, is above it.
    ``sources`` has one row per source.
    """
    cap = F.col("source_size") * max_repeats
    order = [cap / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here_on = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / F.sum("weight").over(here_on))
    out = sources.withColumn("_level", level).withColumn("_limited", F.col("_level") * F.col("weight") >= cap)
    # The level of the first source that is not limited holds for all of them.
    final = F.min(F.when(~F.col("_limited"), F.struct(F.col("_rank"), F.col("_level")))).over(everything)["_level"]
    out = out.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return (out.withColumn("target", F.when(F.col("_limited"), cap.cast("double")).otherwise(final * F.col("weight")))
            .drop("_level", "_limited", "_rank"))


def _cut(packets: DataFrame, budget: int) -> DataFrame:
    """The packets that fit the budget in the order of finish time (then source, row, round).

    Sizes are summed over ranges of the finish time.  The range in which the
    budget ends is cut into ranges again, until few packets are left to rank.
    """
    base, scale, room, left, taken = 0.0, float(RANGES), budget, packets, packets.limit(0)
    while True:
        slot = F.floor((F.least(F.col("vft"), F.lit(8.0)) - F.lit(base)) * F.lit(scale))
        sums = left.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        to = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # at most 8 * RANGES rows
        cut = (sums.withColumn("run", F.sum("size").over(to)).filter(F.col("run") > room)
               .orderBy("slot").limit(1).collect())
        if not cut:
            return taken.unionByName(left)
        edge = cut[0]["slot"]
        taken, left = taken.unionByName(left.filter(slot < edge)), left.filter(slot == edge)
        room -= cut[0]["run"] - cut[0]["size"]
        if cut[0]["n"] <= RANKED_ROWS or scale > 1e13:
            break
        base, scale = base + edge / scale, scale * RANGES
    run = F.sum("size").over(Window.orderBy("vft", "s", "row", "round").rowsBetween(Window.unboundedPreceding, 0))
    return taken.unionByName(left.withColumn("run", run).filter(F.col("run") <= room).drop("run"))


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``docs``: ``doc_id``, ``source``, ``size``.  Returns one row per document:
    ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rounds``
    (times taken) and ``taken`` (size times rounds)."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    d = stored(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"))
               .withColumn("key", key).withColumn("row", F.monotonically_increasing_id()))
    n = d.count()
    digits = 1
    while 16 ** digits * ROWS_PER_PIECE < n:
        digits += 1
    d = d.withColumn("piece", F.substring("key", 1, digits))
    src = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a join key that null has too
    pieces = stored(d.groupBy(src.alias("s"), "source", "piece").agg(F.sum("size").alias("piece_size")))
    plan = targets(cyclic_weights(pieces.groupBy("s", "source").agg(F.sum("piece_size").alias("source_size"))),
                   max_repeats)
    budget = pieces.agg(F.sum("piece_size")).first()[0] or 0
    w = Window.partitionBy("s").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.withColumn("before", F.coalesce(F.sum("piece_size").over(w), F.lit(0)))
              .select("s", "piece", "before").join(plan.drop("source"), "s"))
    in_piece = Window.partitionBy("s", "piece").orderBy("key", "size", "row").rowsBetween(
        Window.unboundedPreceding, 0)
    queue = (d.withColumn("s", src).withColumn("done", F.sum("size").over(in_piece))
             .join(starts, ["s", "piece"]))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    sent = F.col("before") + F.col("done") + F.col("round") * F.col("source_size")
    packets = (queue.filter("size > 0").select("row", "size", "source_size", "target", "before", "done",
                                               "s", rounds.alias("round"))
               .withColumn("vft", sent / F.col("target")))
    packets = stored(packets.select("row", "s", "round", "size", "vft"))
    taken = _cut(packets, budget)
    got = taken.groupBy("row").agg(F.count(F.lit(1)).alias("rounds"))
    return (queue.join(got, "row", "left")
            .withColumn("rounds", F.coalesce("rounds", F.lit(0)).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "rounds",
                    (F.col("size") * F.col("rounds")).alias("taken")))
