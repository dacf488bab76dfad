"""Hand-derived golden values (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from braid.functions import text as tx
from braid.operators import losses as ls
from braid.operators import metrics as mt
from braid.operators import splits as sp
from braid.operators import stats as st
from braid.operators import weighting as wt


def _plan(spark, ns, batch):
    counts = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(ns)], "task string, n bigint")
    tasks = spark.createDataFrame([(f"t{i}", i) for i in range(len(ns))], "task string, task_idx int")
    rows = sorted(sp.split_plan(counts, tasks, batch).collect(), key=lambda r: r["task_idx"])
    return (tuple(r["dev_n"] for r in rows), tuple(r["batch_size"] for r in rows), rows[0]["train_batches"])


@pytest.mark.parametrize("ns,batch,dev,bs,tb", [
    ((1000, 399, 500), 72, (88, 39, 44), (38, 15, 19), 24),
    ((1000, 399, 500), 60, (136, 48, 68), (32, 13, 16), 27),
    ((25, 25, 25), 9, (1, 1, 1), (3, 3, 3), 8),
])
def test_split_plan_golden(spark, ns, batch, dev, bs, tb):
    assert _plan(spark, ns, batch) == (dev, bs, tb)


def test_batch_size_zero_raises(spark):
    with pytest.raises(Exception, match="rounds to 0"):
        _plan(spark, (1000, 1, 500), 9)


def test_class_weights_golden(spark):
    df = spark.createDataFrame([("t", "a", 6), ("t", "b", 3), ("t", "c", 1)], "task string, label string, n bigint")
    got = {r["label"]: (r["weight"], r["freq_rank"]) for r in st.class_weights(df).collect()}
    assert got["a"][0] == pytest.approx(0.510826, abs=1e-6)
    assert got["b"][0] == pytest.approx(1.203973, abs=1e-6)
    assert got["c"][0] == pytest.approx(2.302585, abs=1e-6)
    assert [got[k][1] for k in "abc"] == [1, 2, 3]


def _toks(p, n):
    return [f"{p}{i}" for i in range(n)]


@pytest.mark.parametrize("lq,la,m,qm,am,q_kept,a_kept", [
    (6, 5, 14, 4, 3, _toks("q", 6), _toks("a", 5)),
    (8, 7, 12, 5, 4, ["q0", "q1", "q5", "q6", "q7"], ["a0", "a1", "a5", "a6"]),
    (2, 12, 12, 5, 4, ["q0", "q1"], ["a0", "a1", "a2", "a9", "a10", "a11"]),
    (12, 2, 12, 5, 4, ["q0", "q1", "q2", "q9", "q10", "q11"], ["a0", "a1"]),
    (9, 10, 20, 4, 12, _toks("q", 9), _toks("a", 8)),
])
def test_pair_trim_golden(spark, lq, la, m, qm, am, q_kept, a_kept):
    df = spark.createDataFrame([(_toks("q", lq), _toks("a", la))], "a array<string>, b array<string>")
    a2, b2 = tx.trim_pair("a", "b", m, qm, am)
    r = df.select(a2.alias("a"), b2.alias("b")).first()
    assert (list(r["a"]), list(r["b"])) == (q_kept, a_kept)


def _brute_longest_first(la, lb, m):
    while la + lb > m:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def test_longest_first_closed_form_matches_loop(spark):
    cases = [(la, lb, m) for la in range(0, 12) for lb in range(0, 12) for m in (0, 1, 5, 9, 17)]
    df = spark.createDataFrame(cases, "la int, lb int, m int")
    a2, b2 = tx.longest_first_lengths(F.col("la"), F.col("lb"), F.col("m"))
    got = {(r["la"], r["lb"], r["m"]): (r["a2"], r["b2"]) for r in df.select("*", a2.alias("a2"), b2.alias("b2")).collect()}
    for c in cases:
        assert got[c] == _brute_longest_first(*c), c


@pytest.fixture()
def scored(spark):
    return spark.createDataFrame(
        [("t", 0, [2.0, 1.0, 0.0]), ("t", 2, [0.0, 1.0, 0.0]), ("t", 2, [1.0, 0.0, 3.0])],
        "task string, label_idx int, logits array<double>")


@pytest.fixture()
def weights(spark):
    return spark.createDataFrame([("t", 0, math.log(3)), ("t", 1, math.log(3)), ("t", 2, math.log(1.5))],
                                 "task string, label_idx int, weight double")


def test_cross_entropy_golden(scored, weights):
    assert ls.cross_entropy(scored).first()["loss"] == pytest.approx(0.709632, abs=1e-6)
    assert ls.cross_entropy(scored, weights=weights).first()["loss"] == pytest.approx(0.599999, abs=1e-6)


def test_focal_golden(scored, weights):
    alpha = ls.alpha_table(weights)
    assert ls.focal(scored, alpha, mode="paired").first()["loss"] == pytest.approx(0.056676, abs=1e-6)
    assert ls.focal(scored, alpha, mode="broadcast").first()["loss"] == pytest.approx(0.082606, abs=1e-6)


def test_focal_smooth_range(scored, weights):
    with pytest.raises(ValueError):
        ls.focal(scored, ls.alpha_table(weights), smooth=1.5)


def test_dice_golden(scored):
    assert ls.dice(scored, mode="probs").first()["loss"] == pytest.approx(-1.572429, abs=1e-6)
    assert ls.dice(scored, mode="raw").first()["loss"] == pytest.approx(-1.366667, abs=1e-6)


def test_loss_selector_errors(scored):
    with pytest.raises(ValueError):
        ls.compute(scored, "hinge")
    with pytest.raises(ValueError):
        ls.compute(scored, "focal_loss")


def _log(spark, rows):
    return spark.createDataFrame(rows, "run_id string, epoch bigint, step bigint, task string, loss double, acc double")


def test_dwa_golden(spark):
    rows = []
    for t, l2 in zip("abc", (0.9, 0.8, 1.1)):
        rows += [("r", 1, 1, t, 1.0, 0.5), ("r", 1, 2, t, l2, 0.5), ("r", 1, 3, t, 1.0, 0.5)]
    w = {r["task"]: r["weight"] for r in wt.dwa(_log(spark, rows), mode="paper").filter("step = 3").collect()}
    assert w["a"] == pytest.approx(0.981547, abs=1e-6)
    assert w["b"] == pytest.approx(0.933676, abs=1e-6)
    assert w["c"] == pytest.approx(1.084777, abs=1e-6)
    assert sum(w.values()) == pytest.approx(3.0)
    first = wt.dwa(_log(spark, rows), mode="paper").filter("step < 3").collect()
    assert all(r["weight"] == 1.0 for r in first)


def test_dtp_golden(spark):
    rows = [("r", 1, 1, t, 1.0, a) for t, a in zip("abc", (0.0, 0.5, 1.0))]
    w = {r["task"]: r["weight"] for r in wt.dtp(_log(spark, rows)).collect()}
    assert w["a"] == pytest.approx(2.184424, abs=1e-6)
    assert w["b"] == pytest.approx(0.490129, abs=1e-6)
    assert w["c"] == pytest.approx(0.001005, abs=1e-6)


def test_uw_golden(spark):
    rows = [("r", 1, 1, t, l, 0.5) for t, l in zip("abc", (1.0, 2.0, 0.5))]
    s = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", -0.5)], "task string, s double")
    tot = wt.uw(_log(spark, rows), s).agg(F.sum("term")).first()[0]
    assert tot == pytest.approx(3.037422, abs=1e-6)


def test_strategy_errors(spark):
    log = _log(spark, [("r", 1, 1, "a", 1.0, 0.5)])
    with pytest.raises(ValueError):
        wt.total_loss(log, "pcgrad_only")
    with pytest.raises(ValueError):
        wt.total_loss(log, "dwa", use_pcgrad=True)


def test_macro_f1_golden(spark):
    truth, pred = [0, 0, 1, 2, 2], [0, 1, 1, 1, 3]
    df = spark.createDataFrame([("t", a, b) for a, b in zip(truth, pred)], "task string, label_idx int, pred_idx int")
    pc = {r["class_idx"]: r["f1"] for r in mt.per_class(mt.confusion(df)).collect()}
    assert pc[0] == pytest.approx(2 / 3) and pc[1] == pytest.approx(0.5) and pc[2] == 0 and pc[3] == 0
    assert mt.macro_f1(df).first()["macro_f1"] == pytest.approx(0.291667, abs=1e-6)
