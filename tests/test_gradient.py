"""Gradient heads against a plain loop."""

import numpy as np

from braid.operators import gradient as gr

ROWS = "kind string, task string, split string, id long, label_idx int, epoch long, step long, slot array<int>, value array<double>"
SLOTS = 8


def table(n, seed, kind="train", classes=None):
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        task, c = [("a", 3), ("b", 2)][i % 2]
        k = int(g.integers(0, 6))  # none at all, too
        out.append((kind, task, "train", i, int(g.integers(c)), 1, i // 5, [int(x) for x in g.integers(0, SLOTS, k)],
                    [float(x) for x in g.random(k)]))
    return out


def probabilities(w, slot, value):
    z = [w[SLOTS][k] + sum(v * w[s][k] for s, v in zip(slot, value, strict=True)) for k in range(len(w[0]))]
    e = [np.exp(x) for x in z]
    return z, [x / sum(e) for x in e]


def plain(blocks, dev, classes, rate, momentum):
    w = {t: np.zeros((SLOTS + 1, n)) for t, n in classes.items()}
    m = {t: np.zeros_like(x) for t, x in w.items()}
    passes = []
    for rows in blocks:
        grad, n = {t: np.zeros_like(x) for t, x in w.items()}, dict.fromkeys(classes, 0)
        seen = []
        for kind, task, _, i, y, _, _, slot, value in rows + (dev if passes else []):
            z, p = probabilities(w[task], slot, value)
            seen.append((kind, task, i, z))
            if kind == "train":
                n[task] += 1
                for k in range(classes[task]):
                    miss = p[k] - (k == y)
                    grad[task][SLOTS][k] += miss
                    for s, v in zip(slot, value, strict=True):
                        grad[task][s][k] += miss * v
        for t in classes:
            m[t] = momentum * m[t] - rate * grad[t] / max(1, n[t])
            w[t] = w[t] + m[t]
        passes.append(seen)
    return passes, w


def test_against_plain_loop(spark):
    classes = {"a": 3, "b": 2}
    blocks = [table(37, 1), table(20, 2), [r for r in table(12, 3) if r[1] == "a"], table(9, 4)]
    dev = table(15, 5, "dev")
    keep = lambda df, by=(): df.cache()
    frames = [spark.createDataFrame(b, ROWS).repartition(3) for b in blocks]
    passes, states = gr.train(frames, spark.createDataFrame(dev, ROWS), classes, SLOTS, keep)
    want, w = plain(blocks, dev, classes, gr.RATE, gr.MOMENTUM)
    for got, seen in zip(passes, want, strict=True):
        rows = {(r.kind, r.task, r.id): r.logits for r in got.filter("kind <> 'grad'").collect()}
        assert rows.keys() == {s[:3] for s in seen}
        for kind, task, i, z in seen:
            assert np.allclose(rows[kind, task, i], z)
    last = gr.fetched(states[-1], classes, SLOTS)
    assert all(np.allclose(last[t], w[t]) for t in classes)
    # From a stored state training goes on as if it had not stopped.
    _, again = gr.train(frames[2:], spark.createDataFrame(dev, ROWS), classes, SLOTS, keep, state=states[1])
    more = gr.fetched(again[-1], classes, SLOTS)
    assert all(np.allclose(more[t], w[t]) for t in classes)


def test_little_room_changes_nothing():
    g = np.random.default_rng(0)
    w = g.normal(size=(SLOTS + 1, 4))
    start = np.array([0, 0, 3, 3, 7])
    slot, value = g.integers(0, SLOTS, 7), g.random(7)
    z = gr.logits_of(w, start, slot, value)
    for k in range(4):
        a, b = start[k], start[k + 1]
        assert np.allclose(z[k], w[SLOTS] + sum((v * w[s] for s, v in zip(slot[a:b], value[a:b], strict=True)), np.zeros(4)))


def test_slots_for_many_labels():
    assert gr.slots_for(14) == gr.FEATURES
    for labels in (500, 5000, 100_000):
        n = gr.slots_for(labels)
        assert (n + 1) * labels <= gr.MAX_CELLS and (2 * n + 1) * labels > gr.MAX_CELLS or n == gr.FEATURES


def test_five_thousand_labels(spark):
    """Heads for many labels learn what tells them apart."""
    labels = 5000
    slots = gr.slots_for(labels)
    rows = [("train", "t", "train", i, i % labels, 1, 1, [i % slots], [1.0]) for i in range(2000)]
    frame = spark.createDataFrame(rows, ROWS)
    keep = lambda df, by=(): df.cache()
    passes, states = gr.train([frame, frame], frame.limit(0), {"t": labels}, slots, keep, rate=2000.0)
    got = passes[1].filter("kind = 'train'").select("label_idx", "logits").limit(50).collect()
    assert len(got) == 50 and np.mean([np.argmax(r.logits) % slots == r.label_idx % slots for r in got]) > 0.9


def test_features(spark):
    counts = spark.createDataFrame([("t", "train", 1, "x", 3), ("t", "train", 1, "y", 4), ("t", "dev", 2, "x", 1)],
                                   "task string, split string, id long, token string, cnt long")
    rows = spark.createDataFrame([("t", "train", 1, 0), ("t", "dev", 2, 1), ("t", "dev", 3, None)],
                                 "task string, split string, id long, label_idx int")
    import hashlib
    slot = {x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 64 for x in "xy"}
    got = {r.id: dict(zip(r.slot, r.value, strict=True)) for r in gr.feature_rows(counts, rows, 64).collect()}
    assert got == {1: {slot["x"]: 0.6, slot["y"]: 0.8}, 2: {slot["x"]: 1.0}, 3: {}}
