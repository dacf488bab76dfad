"""N-gram join against all pairs in plain Python."""

import random
import re

import pytest

from braid.llm import ngram_join as nj
from braid.llm import shards


def sets(text, k):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    """Sorted (id, set size, smallest id reachable)."""
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(s[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed, groups, copies, spread=12):
    """Groups of near copies whose likeness lies around the limit, and loners."""
    g = random.Random(seed)
    word = lambda: "w" + str(g.randint(0, 400))
    rows, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(g.randint(8, 60))]
        for _ in range(g.randint(1, copies)):
            t = list(base)
            for _ in range(g.randint(0, max(1, len(t) // spread))):
                t[g.randrange(len(t))] = word()
            rows.append((n * 7 % 1009, " ".join(t)))
            n += 1
    return rows


@pytest.mark.parametrize(("short", "block", "rounds"), [(64, 512, 2), (2, 4, 1), (0, 3, 0)])
def test_random(spark, monkeypatch, short, block, rounds):
    monkeypatch.setattr(nj, "SHORT_LIST", short)
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(shards, "SHARD_BYTES", 3000)
    rows = corpus(short, 12, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(nj.ngram_join(df, 4, 85)) == brute(rows, 4, 85)
    if short == 2:
        assert got(nj.ngram_join(df, 2, 60)) == brute(rows, 2, 60)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one"), (8, "ONE"), (7, "one two three"), (6, "one\ttwo  three"),
            (10, "a b c d"), (11, "a b c e"), (12, long), (13, long + " end"), (None, "x y z q r"), (14, "X y z q R"),
            (15, "p q r s t u"), (15, "p q r s t u"), (15, "other text of five words"), (None, "null id alone here"),
            (20, "café café É"), (21, "café café é")]
    df = spark.createDataFrame([(i, t, "r", 1, "s") for i, t in rows], "doc_id long, text string, rid string, n int, sig string")
    assert got(nj.ngram_join(df, 4, 85)) == brute(rows, 4, 85)
    assert nj.ngram_join(df.limit(0), 4, 85).count() == 0
