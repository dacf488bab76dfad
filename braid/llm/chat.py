"""Chat formatting from reply trees (DataFrame functions only).

``reply_paths`` enumerates every root-to-leaf path of a forest of messages with
iterative self-joins.  Jump tables (the 1st, 2nd, 4th, ... ancestor of every
node) are built by joining the table with itself, then each leaf is expanded
with the jumps from the longest to the shortest, so a path of d messages takes
about 2*log2(d) joins and no step holds more rows than the paths themselves.
``rank_branches`` ranks the paths of a tree by score and ``format_paths``
renders each chosen path as one conversation with the spans that carry loss.

Defined results.  Null text or role: empty.  Null tree id: one tree of its own.
Null score: 0.  A parent that does not exist makes its child a root.  Messages
on a reply cycle, or below one, reach no root and belong to no path.  Repeated
(tree, node) rows: the smallest (parent, role, text) counts.  Equal branch
scores: the smaller leaf id first.  An empty table gives an empty result.  Other
columns are ignored, whatever their names.  One conversation is one string, so
it must fit one row; nothing else is gathered per tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The template: "### <role>: <text></turn>\n" for every turn.
HEAD, SEP, END = "### ", ": ", "</turn>\n"
# A backslash starts an escape and nothing else, so the characters the control
# strings are made of never occur raw inside an escaped role or text.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(c: Column) -> Column:
    for raw, esc in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def unescape(c: Column) -> Column:
    for raw, esc in reversed(ESCAPES):
        c = F.replace(c, F.lit(esc), F.lit(raw))
    return c


def _clean(nodes: DataFrame) -> DataFrame:
    """One row per (tree key, node): ``t``, ``node``, ``parent``, ``role``, ``text``, ``score``."""
    rows = nodes.select(
        F.coalesce(F.col("tree_id").cast("string"), F.lit("null")).alias("t"), F.col("tree_id"),
        F.col("node_id").alias("node"),
        F.struct(F.col("parent_id").alias("parent"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"),
                 F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("m"))
    return (rows.filter("node IS NOT NULL").groupBy("t", "node")
            .agg(F.first("tree_id").alias("tree_id"), F.min("m").alias("m")).select("t", "tree_id", "node", "m.*"))


def reply_paths(nodes: DataFrame) -> DataFrame:
    """Rows (``t``, ``tree_id``, ``leaf``, ``pos`` from 0 at the root, ``node``,
    ``role``, ``text``, ``score``): every root-to-leaf path of every tree.

    ``nodes``: ``tree_id``, ``node_id``, ``parent_id``, ``role``, ``text``, ``score``.
    """
    msgs = stored(_clean(nodes))
    keys = msgs.select("t", "node")
    # Jump table of one step; a parent that is not there leaves its child a root.
    jump = stored(msgs.filter("parent IS NOT NULL").select("t", "node", F.col("parent").alias("up"))
                  .join(keys.select("t", F.col("node").alias("up")), ["t", "up"], "left_semi")
                  .select("t", "node", "up"))
    rounds = max(1, math.ceil(math.log2(max(2, msgs.count()))) + 1)
    jumps, cyclic = [], False
    left = jump.count()
    while left and not cyclic:
        jumps.append(jump)
        far = jump.select("t", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = stored(jump.join(far, ["t", "up"]).select("t", "node", F.col("up2").alias("up")))
        left = jump.count()
        cyclic = left > 0 and len(jumps) > rounds
    leaves = keys.join(jumps[0].select("t", F.col("up").alias("node")), ["t", "node"], "left_anti") if jumps else keys
    if cyclic:  # what can still jump after more steps than there are messages never ends
        leaves = leaves.join(jump.select("t", "node"), ["t", "node"], "left_anti")
    paths = leaves.select("t", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k in reversed(range(len(jumps))):
        step = paths.join(jumps[k], ["t", "node"]).select("t", "leaf", F.col("up").alias("node"),
                                                          (F.col("dist") + (1 << k)).alias("dist"))
        paths = stored(paths.unionByName(step))
    w = Window.partitionBy("t", "leaf")
    return (paths.join(msgs, ["t", "node"])
            .withColumn("pos", F.max("dist").over(w) - F.col("dist"))
            .select("t", "tree_id", "leaf", "pos", "node", "role", "text", "score"))


def rank_branches(paths: DataFrame, best: int | None = None) -> DataFrame:
    """Adds ``branch_score`` (sum over the path) and ``branch_rank`` (1 is the
    best of its tree); keeps the ``best`` first branches, or all."""
    sums = paths.groupBy("t", "leaf").agg(F.sum("score").alias("branch_score"))
    ranked = sums.withColumn("branch_rank", F.row_number().over(
        Window.partitionBy("t").orderBy(F.col("branch_score").desc(), "leaf")))
    if best is not None:
        ranked = ranked.filter(F.col("branch_rank") <= best)
    return paths.join(ranked, ["t", "leaf"])


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: ``tree_id``, ``leaf``, ``branch_rank``, ``branch_score``,
    ``formatted`` and ``loss_spans`` (start, end in code points of ``formatted``,
    end excluded: the escaped text of every assistant turn, in order)."""
    w = Window.partitionBy("t", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    body = escape(F.col("text"))
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(SEP))
    turn = paths.select("t", "tree_id", "leaf", "pos", "role", "branch_rank", "branch_score",
                        head.alias("head"), body.alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END)))
    at = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)) + F.length("head")
    turn = turn.withColumn("start", at.cast("long")).withColumn("end", F.col("start") + F.length("body"))
    out = turn.groupBy("t", "leaf").agg(
        F.first("tree_id").alias("tree_id"), F.first("branch_rank").alias("branch_rank"),
        F.first("branch_score").alias("branch_score"),
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("start", "end")))).alias("loss_spans"))
    return out.select("tree_id", "leaf", "branch_rank", "branch_score",
                      F.array_join(F.col("p.piece"), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        cut = F.locate(SEP, p)
        return F.struct(
            unescape(F.substring(p, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(p, cut + len(SEP), F.length(p))).alias("text"))
    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(
        spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Reply trees of a table of plain conversations (``conv_id``, ``turn``,
    ``role``, ``text``): each turn replies to the one before it; equal turns in
    the order of (role, text).  A longer text scores higher."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (turns.withColumn("node_id", F.row_number().over(w).cast("long"))
            .select(F.col("conv_id").alias("tree_id"), "node_id",
                    F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text",
                    F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")))
