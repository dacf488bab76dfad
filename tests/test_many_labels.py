"""Heads of many labels: as many slots as those of few, and the same numbers wherever they are held."""

import numpy as np
import pytest

from braid.operators import gradient as gr

from tests.test_gradient import ROWS, SLOTS, plain, table


def test_slots_do_not_depend_on_the_number_of_labels():
    assert {gr.slots_for(n) for n in (1, 14, 244, 245, 5000, 1_000_000)} == {gr.FEATURES}


@pytest.mark.parametrize("cells", [0, 44, 4_000_000])
def test_heads_are_the_same_wherever_they_are_held(spark, monkeypatch, cells):
    """Above ``MAX_CELLS`` heads, gradients and states are mapped from files; before, there were fewer slots."""
    monkeypatch.setattr(gr, "MAX_CELLS", cells)
    monkeypatch.setattr(gr, "AT_ONCE", 7)
    classes = {"a": 3, "b": 2}
    blocks, dev = [table(37, 1), [r for r in table(12, 3) if r[1] == "a"], table(9, 4)], table(15, 5, "dev")
    keep = lambda df, by=(): df.localCheckpoint()
    frames = [spark.createDataFrame(b, ROWS).repartition(3) for b in blocks]
    passes, states = gr.train(frames, spark.createDataFrame(dev, ROWS), classes, SLOTS, keep)
    want, w = plain(blocks, dev, classes, gr.RATE, gr.MOMENTUM)
    for got, seen in zip(passes, want, strict=True):
        rows = {(r.kind, r.task, r.id): r.logits for r in got.filter("kind <> 'grad'").collect()}
        assert rows.keys() == {s[:3] for s in seen} and all(np.allclose(rows[s[:3]], s[3]) for s in seen)
    last = gr.fetched(states[-1], classes, SLOTS)
    assert all(np.allclose(last[t], w[t]) for t in classes)
    _, again = gr.train(frames[1:], spark.createDataFrame(dev, ROWS), classes, SLOTS, keep, state=states[0])
    assert all(np.allclose(gr.fetched(again[-1], classes, SLOTS)[t], w[t]) for t in classes)


def test_a_task_of_many_labels_takes_no_slots_from_another(spark):
    """600 labels beside a task of two: with fewer slots, two tokens of the small task would share one."""
    apart = gr.FEATURES // 2
    rows = [("train", "two", "train", i, i % 2, 1, 1, [i % 2 * apart], [1.0]) for i in range(20)]
    rows += [("train", "many", "train", i, i, 1, 1, [i], [1.0]) for i in range(600)]
    frame = spark.createDataFrame(rows, ROWS).repartition(2)
    keep = lambda df, by=(): df.localCheckpoint()
    classes = {"two": 2, "many": 600}
    _, states = gr.train([frame], frame.limit(0), classes, gr.slots_for(602), keep)
    head = gr.fetched(states[0], classes, gr.FEATURES)["two"]
    assert np.array_equal(head[0], [0.5, -0.5]) and np.array_equal(head[apart], [-0.5, 0.5])
    assert np.count_nonzero(head.any(axis=1)) == 2
