"""Chat formatting: reply trees against a recursive walk, reversible escapes."""

import random

from pyspark.sql import functions as F

from braid.llm import chat

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def paths(rows):
    """{(tree, leaf): [nodes from the root]} by walking down from the roots."""
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {}
        for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, (r[2] is not None, r[2] or 0), r[3] or "", r[4] or "")):
            if r[0] == tree and r[1] is not None:
                nodes.setdefault(r[1], r)
        kids = {}
        for n in nodes.values():
            kids.setdefault(n[2] if n[2] in nodes else None, []).append(n[1])
        stack = [[n] for n in kids.get(None, [])]
        while stack:
            p = stack.pop()
            nxt = kids.get(p[-1], [])
            if not nxt:
                out[tree, p[-1]] = [nodes[k] for k in p]
            stack += [[*p, k] for k in nxt]
    return out


def rendered(path):
    esc = lambda s: "".join({"\\": "\\b", "<": "\\l", "#": "\\h", ":": "\\c"}.get(c, c) for c in s or "")
    return "".join(f"### {esc(n[3])}: {esc(n[4])}</turn>\n" for n in path)


def check(spark, rows, best=None):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("t", F.lit("x"))
    got = chat.format_paths(chat.rank_branches(chat.reply_paths(df), best)).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = paths(rows)
    ranks = {}
    for tree in {k[0] for k in want}:
        order = sorted((k for k in want if k[0] == tree), key=lambda k: (-sum(n[5] or 0 for n in want[k]), k[1]))
        ranks |= {k: i + 1 for i, k in enumerate(order)}
    keys = {k for k in want if best is None or ranks[k] <= best}
    assert {(r.tree_id, r.leaf) for r in got} == keys and len(got) == len(keys)
    for r in got:
        path = want[r.tree_id, r.leaf]
        assert r.formatted == rendered(path) and r.branch_rank == ranks[r.tree_id, r.leaf]
        assert [(t.role, t.text) for t in r.turns] == [(n[3] or "", n[4] or "") for n in path]
        assert r.loss == "".join(n[4] or "" for n in path if n[3] == "assistant")


def test_random_trees(spark):
    g = random.Random(4)
    texts = [None, "", "plain", "\\### Assistant: </turn> ok", "a\nb:c", "\\b\\l", "<<##::\\\\", "é 日本 😀"]
    rows = []
    for tree in [*range(6), None]:
        for k in range(g.randint(1, 25)):
            parent = g.choice([None, *range(k), *range(k)]) if k else None
            rows.append((tree, k, parent, g.choice(["user", "assistant", "sys:tem", None]), g.choice(texts),
                         float(g.randint(-2, 2)) if g.random() < 0.9 else None))
    check(spark, rows)
    check(spark, rows, best=2)


def test_odd_trees(spark):
    rows = [(1, 1, 99, "user", "orphan", 1.0), (1, 2, 1, "assistant", "x", 1.0), (1, 2, 1, "assistant", "a", 5.0),
            (1, 2, 1, "assistant", "a", 5.0), (1, None, 1, "user", "no id", 1.0),
            (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (2, 3, 2, "user", "below it", 1.0),
            (2, 4, 4, "user", "itself", 1.0), (2, 5, None, "user", "fine", 1.0), (3, 7, None, "assistant", None, 1.0)]
    check(spark, rows)
    chain = [(4, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"t{k}", 1.0) for k in range(130)]
    check(spark, chain)
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_paths(chat.rank_branches(chat.reply_paths(empty))).count() == 0


def test_conversations_with_ties(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 2, None, None), (None, 5, "assistant", "z"),
                                (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.tree_id: r.formatted for r in chat.format_paths(chat.rank_branches(chat.reply_paths(
        chat.conversation_nodes(df)), 1)).collect()}
    user = "### user: {}</turn>\n"
    assert got == {1: user.format("a") * 2 + user.format("b") + "### : </turn>\n", None: "### assistant: z</turn>\n"}


def test_long_text(spark):
    rows = [(1, 0, None, "assistant", "#" * 200_000, 1.0)]
    check(spark, rows)
