"""Mixing: targets by repeated resharing, the queue in plain Python."""

import hashlib
import random

import pytest

from braid.llm import mixing

SF = "/root/testdata/sf0.01"


def level(sizes, weights, most=3):
    """Targets by resharing the excess until none is above its limit."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        weight = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / weight >= most * sizes[s]] if free else []
        if not over:
            return capped | {s: rest * weights[s] / weight for s in free}
        capped |= {s: most * sizes[s] for s in over}


def brute(rows):
    """(id, source) -> (source size, target, taken), ids being unique."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    sizes = {s: sum(z for _, t, z in rows if t == s) for s in names}
    want, packets = level(sizes, weights), []
    for s in names:
        sent, mine = 0, sorted((r for r in rows if r[1] == s),
                               key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}|{mixing.SEED}".encode()).hexdigest())
        for _ in range(3):
            for i, _, z in mine:
                sent += z
                if z:
                    packets.append((sent / want[s], "" if s is None else "=" + s, i, z))
    taken, run = {}, 0
    for _, _, i, z in sorted(packets, key=lambda p: p[:2]):
        run += z
        if run > sum(sizes.values()):
            break
        taken[i] = taken.get(i, 0) + z
    return {i: (sizes[s], want[s], taken.get(i, 0)) for i, s, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "ROWS_PER_PIECE", 8)
    monkeypatch.setattr(mixing, "RANGES", 4)
    monkeypatch.setattr(mixing, "RANKED_ROWS", 5)
    g = random.Random(seed)
    rows = [(i, g.choice(["a", "a", "a", "b", "é", "Z", None, "a\u0000", ""]), g.choice([0, 1, 5, 40, 900])) for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, size long, row int, key string")
    got = {r.doc_id: (r.source_size, r.target, r.taken) for r in mixing.mix(df.repartition(3)).collect()}
    want = brute(rows)
    assert {i: (a, c) for i, (a, _, c) in got.items()} == {i: (a, c) for i, (a, _, c) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {i: c for i, (_, _, c) in got.items()}


def test_targets_are_met(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", mixing.word_count("text").alias("size"))
    rows = mixing.mix(df).collect()
    most = max(r.size for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= most
    assert all(r.taken <= 3 * r.size for r in rows)


def test_edges(spark):
    text = spark.createDataFrame([("a  b\tc\x0bd e\x1cf",), (None,), ("",), (" \n",)], "text string")
    assert [r[0] for r in text.select(mixing.word_count("text")).collect()] == [4, 0, 0, 0]
    schema = "doc_id long, source string, size long"
    one = mixing.mix(spark.createDataFrame([(1, "a", 5)], schema)).collect()
    assert [(r.target, r.taken) for r in one] == [(5.0, 5)]
    empty = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, 0), (None, "a", None)], schema).fillna(0)).collect()
    assert [(r.source_size, r.taken) for r in empty] == [(0, 0)] * 3
    twice = mixing.mix(spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 5)], schema)).collect()
    assert len(twice) == 3 and sum(r.taken for r in twice) <= 15
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
