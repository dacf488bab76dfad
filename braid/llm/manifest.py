"""Merkle manifest of a document table: checkpointed levels, recomputed proofs.

Every row is a leaf, a hash of its columns.  The leaves of a language, ascending by
id, are a tree: every ``FAN`` consecutive nodes of a level are hashed into
one of the next.  The tops of the trees (subroots), ascending by language, are the leaves of
one more tree, whose top is the root.

Only every ``HEIGHT``-th level is stored (``build``).  The levels between are
those of aligned subtrees of FAN ** HEIGHT stored nodes: ``paths`` computes
them again from one row that holds a subtree's nodes, emits each node's
siblings up to the subtree's top, followed by the path of that top, and forgets them.
A subtree is a group of bounded size, so a large language is as many groups as
it has subtrees; positions come from a range sort, not from a window over a language.

Defined results.  A null column is ``-`` in the hash, an empty text ``0:``.  A null
language is a tree of its own, the first; null ids come first, equal ids in the order of their
leaves.  Repeated rows are leaves as often as they occur; equal leaves are
interchangeable.  A lone leaf is its tree's top.  Empty table: no rows, root None.  Other columns of
the table are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored

FAN, HEIGHT = 8, 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def whole(c: Column, by: int) -> Column:
    """Integer quotient."""
    return F.call_function("div", c, F.lit(by))


def leaf_hash(**instead: Column) -> Column:
    """Hash of a row's ``FIELDS`` (``instead``: other columns for some of them)."""
    def field(name: str) -> Column:
        c = instead.get(name, F.col(name)).cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(F.concat(*map(field, FIELDS)))


def tree_key(lang: Column) -> Column:
    """A string that sorts as languages do, null first; never null."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place (from 0) of each row in its ``tree`` by ``order``,
    and ``n``, the rows of the tree.  A range sort by tree and order deals
    the rows; per tree and partition one number says what lies before.  Rows alike are split too."""
    placed = stored(rows.withColumn("_tie", F.monotonically_increasing_id())
                    .repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order)
                    .drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored(runs.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"),
                              F.sum("_n").over(tree).alias("n")))
    return (placed.withColumn("_part", part).join(small_side(runs), ["tree", "_part"])
            .select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "n"))


def subtrees(nodes: DataFrame, carry: list[str], fan: int, height: int) -> DataFrame:
    """One row per aligned subtree of ``nodes`` (``tree``, ``n``, ``pos``, ``node``): ``sub``, its place among them; ``kept``,
    its nodes in order with the ``carry`` columns; ``levels``, how many levels it climbs (fewer than ``height`` where its tree ends)."""
    levels = F.lit(height)
    for h in reversed(range(height)):
        levels = F.when(F.col("n") <= fan ** h, h).otherwise(levels)
    sub = whole(F.col("pos"), fan ** height).alias("sub")
    return (nodes.groupBy("tree", "n", sub).agg(F.array_sort(F.collect_list(F.struct("pos", "node", *carry))).alias("kept"))
            .withColumn("levels", levels))


def parents(level: Column, fan: int) -> Column:
    """Hash of every ``fan`` consecutive nodes."""
    runs = F.sequence(F.lit(0), whole(F.size(level) - 1, fan).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(level, r * fan + 1, F.lit(fan)), "")))


def with_levels(subs: DataFrame, fan: int, height: int) -> DataFrame:
    """Adds the interior levels of each subtree: ``level0`` (its nodes) to ``level<height>`` (its top)."""
    out = subs.withColumn("level0", F.transform("kept", lambda x: x["node"]))
    for h in range(height):
        below = F.col(f"level{h}")
        out = out.withColumn(f"level{h + 1}", F.when(F.col("levels") > h, parents(below, fan)).otherwise(below))
    return out


def own_path(i: Column, fan: int, height: int) -> Column:
    """Siblings of the subtree's ``i``-th node, level by level: what stands left and right of it in its run."""
    steps = []
    for h in range(height):
        at, level = whole(i, fan ** h).cast("int"), F.col(f"level{h}")
        start = whole(at, fan).cast("int") * fan
        steps.append(F.struct(F.array_join(F.slice(level, start + 1, at - start), "").alias("left"),
                              F.array_join(F.slice(level, at + 2, start + fan - 1 - at), "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("levels"))


@dataclass
class Manifest:
    """Stored levels of the trees and of the tree over their tops, and the root.

    ``blocks``: packed subtrees (``subtrees``) of every stored level from the leaves up;
    ``tops``: (``tree``, ``node``) of every tree; ``forest``: the manifest over the tops (None in that one)."""
    blocks: list[DataFrame]
    tops: DataFrame
    root: str | None
    forest: Manifest | None
    carry: list[str]
    fan: int = FAN
    height: int = HEIGHT


def build(leaves: DataFrame, order: list[str], carry: list[str] = (), fan: int = FAN, height: int = HEIGHT,
          single: bool = False) -> Manifest:
    """Manifest of ``leaves`` (``tree``, ``node``, the ``order`` of the leaves in
    a tree, and what ``paths`` shall ``carry``).  ``single``: there is one tree, whose top is the root."""
    carry = list(carry)
    nodes, blocks = positions(leaves, order), []
    while True:
        block = stored(subtrees(nodes, [] if blocks else carry, fan, height))
        blocks.append(block)
        largest = block.agg(F.max("n")).first()[0] or 0
        up = with_levels(block, fan, height).select("tree", "n", "sub", F.element_at(f"level{height}", 1).alias("node"))
        if largest <= fan ** height:
            break
        nodes = up.select("tree", (whole(F.col("n") - 1, fan ** height) + 1).alias("n"), F.col("sub").alias("pos"), "node")
    tops = stored(up.select("tree", "node"))
    if single:
        top = tops.first()
        return Manifest(blocks, tops, top and top.node, None, carry, fan, height)
    over = tops.select(F.lit("").alias("tree"), "node", F.col("tree").alias("of"))
    forest = build(over, ["of"], ["of"], fan, height, single=True)
    return Manifest(blocks, tops, forest.root, forest, carry, fan, height)


def paths(m: Manifest) -> DataFrame:
    """A row per leaf: ``tree``, ``pos``, ``node`` (the leaf), the carried columns, ``subroot``, ``path`` (siblings
    as (left, right) per level up to the subtree's top) and ``upper`` (from there to the root)."""
    step = "array<struct<left:string,right:string>>"
    above = m.tops.select("tree", F.lit(0).cast("long").alias("sub"), F.col("node").alias("subroot"),
                          F.array().cast(step).alias("upper"))
    if m.forest:
        on = paths(m.forest).select(F.col("of").alias("tree"), F.concat("path", "upper").alias("upper"))
        above = above.drop("upper").join(on, "tree")
    for k, block in reversed(list(enumerate(m.blocks))):
        own = F.transform(F.col("kept"), lambda x, i: F.struct(x.alias("x"), own_path(i, m.fan, m.height).alias("path")))
        rows = with_levels(block.join(above, ["tree", "sub"]), m.fan, m.height).select(
            "tree", "subroot", "upper", F.explode(own).alias("e"))
        if k:
            above = rows.select("tree", F.col("e.x.pos").alias("sub"), "subroot", F.concat("e.path", "upper").alias("upper"))
    return rows.select("tree", F.col("e.x.pos").alias("pos"), F.col("e.x.node").alias("node"),
                       *[F.col("e.x")[c].alias(c) for c in m.carry], "subroot", F.col("e.path").alias("path"), "upper")


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The top that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(``tree``, ``doc_id``, ``node``) of a document table, and ``other``: the leaf of the row with
    A-Z of its text lower-cased, for ids whose CRC-32 three divides (else null)."""
    lowered = leaf_hash(text=F.translate("text", CAPITALS, SMALL))
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf_hash().alias("node"),
                       F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered).alias("other"))


def audit(docs: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row of ``docs``."""
    m = build(stored(document_leaves(docs)), ["doc_id", "node"], ["doc_id", "other"], fan, height)
    root, node = F.lit(m.root).cast("string"), F.col("node")
    rows = paths(m).select("doc_id", node.alias("leaf"), "subroot", root.alias("root"),
                           digest(F.concat(siblings(F.col("path")), siblings(F.col("upper")))).alias("proof_sha256"),
                           fold(fold(F.coalesce("other", node), F.col("path")), F.col("upper")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == root)
