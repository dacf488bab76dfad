"""Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import pytest

from braid.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    cells = (r[0], r[3], r[2], r[4], text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in cells))


def climb(nodes, fan):
    """(top, for every leaf its path of (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            a = at[k] // fan * fan
            run = nodes[a:a + fan]
            path.append(("".join(run[:at[k] - a]), "".join(run[at[k] - a + 1:])))
            at[k] //= fan
        nodes = [H(*nodes[a:a + fan]) for a in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain(rows, fan):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    done = []
    for k in order:
        leaves = sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        done.append((leaves, *climb([leaf_of(r, r[1]) for r in leaves], fan)))
    if not done:
        return []
    root, over = climb([top for _, top, _ in done], fan)
    out = []
    for (leaves, top, paths), upper in zip(done, over, strict=True):
        for r, path in zip(leaves, paths, strict=True):
            leaf = node = leaf_of(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                small = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                node = leaf_of(r, small)
            for left, right in path + upper:
                node = H(left, node, right)
            out.append((r[0], leaf, top, root, H(*(a + b for a, b in path + upper)), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, fan=manifest.FAN, height=manifest.HEIGHT):
    got = manifest.audit(spark.createDataFrame(rows, SCHEMA), fan, height).collect()
    return sorted((tuple(r) for r in got), key=str)


def rows_of(n, langs):
    return [(i * 7 % 1000, f"Text {i} É\n" if i % 5 else None, langs[i * i % len(langs)], f"s{i % 3}" if i % 4 else None,
             i if i % 6 else None) for i in range(n)]


@pytest.mark.parametrize("fan,height,n", [(8, 3, 700), (2, 2, 77), (3, 1, 50), (8, 3, 3)])
def test_against_plain(spark, fan, height, n):
    rows = rows_of(n, ["en", "de", None, "", "en", "én"])
    assert run(spark, rows, fan, height) == plain(rows, fan)


def test_many_trees(spark):
    rows = rows_of(120, [f"l{i}" for i in range(40)])
    assert run(spark, rows, 2, 2) == plain(rows, 2)


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(None, None, None, None, None)] * 5 + [(3, "", "en", "", 0)] * 20 + [(3, "A", "en", "", 0), (-9, "long " * 50_000, "x", "s", 1)]
    assert run(spark, rows, 2, 2) == plain(rows, 2)
    one = [(6, "AbC", "en", "s", 3)]
    got = run(spark, one)
    assert got == plain(one, 8) and got[0][4] == H("")  # no siblings at all
    clash = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows],
                                  SCHEMA + ", node string, pos int, tree string, n int, sub int")
    assert sorted((tuple(r) for r in manifest.audit(clash, 2, 2).collect()), key=str) == plain(rows, 2)


def test_only_some_levels_are_stored(spark):
    leaves = spark.range(600).selectExpr("'' AS tree", "id", "sha2(cast(id as string), 256) AS node")
    m = manifest.build(leaves, ["id"], single=True)
    # 600 leaves in two subtrees, then their two tops; levels 1, 2 (and 4, 5) are nowhere.
    assert [b.count() for b in m.blocks] == [2, 1]
    assert max(len(r.kept) for b in m.blocks for r in b.collect()) == 512
    assert m.root == climb([H(str(i)) for i in range(600)], 8)[0]
