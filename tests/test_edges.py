"""Small edge inputs (FIXTURES.md 5)."""

import pytest
from pyspark.sql import functions as F

from braid.config import TaskSpec
from braid.functions import arrays as ar
from braid.functions import text as tx
from braid.operators import examples as ex
from braid.operators import features as fe
from braid.operators import heads as hd
from braid.operators import metrics as mt
from braid.operators import perturb as pt


def test_tokenize_empty_and_null(spark):
    df = spark.createDataFrame([("",), (None,), ("Hello, World 42!",), ("中文字",)], "t string")
    got = [list(r[0]) for r in df.select(tx.tokenize("t")).collect()]
    assert got[0] == [] and got[1] == []
    assert got[2] == ["hello", ",", "world", "42", "!"]
    assert got[3] == ["中", "文", "字"]


def test_encode_empty_and_one_token_pair(spark):
    rows = spark.createDataFrame(
        [("lang", "test", 1, "", None, None), ("turns", "test", 2, "hi", "yo", None)],
        "task string, split string, id bigint, text_a string, text_b string, label_idx int")
    vocab = spark.createDataFrame([(t, 0, i) for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hi"])],
                                  "token string, n bigint, token_id int")
    f = {r["id"]: r for r in fe.encode(rows, vocab).collect()}
    assert list(f[1]["input_ids"][:3]) == [2, 3, 0] and len(f[1]["input_ids"]) == 60
    assert sum(f[1]["attention_mask"]) == 2
    assert list(f[2]["input_ids"][:6]) == [2, 4, 3, 1, 3, 0]
    assert list(f[2]["token_type_ids"][:6]) == [0, 0, 0, 1, 1, 0]


def test_unknown_and_null_labels(spark):
    e = spark.createDataFrame([("t", 1, "a"), ("t", 2, "zz"), ("t", 3, None)], "task string, id bigint, label string")
    dim = spark.createDataFrame([("t", "a", 0)], "task string, label string, label_idx int")
    got = {r["id"]: r["label_idx"] for r in ex.encode_labels(e, dim, "null").collect()}
    assert got == {1: 0, 2: None, 3: None}
    assert {r["id"] for r in ex.encode_labels(e, dim, "drop").collect()} == {1, 3}
    with pytest.raises(Exception, match="unknown label"):
        ex.encode_labels(e, dim, "error").collect()


def test_single_row_label_kept(spark):
    e = spark.createDataFrame([("t", 1, "x", "labelled")], "task string, id bigint, label string, kind string")
    assert ex.build_label_dim(e).count() == 1


def test_text_roundtrip_parquet(spark, tmp_path):
    from braid.sources import tsv
    text = 'say "hi"\tthen\nnew line'
    df = spark.createDataFrame([("t", 1, text, None, "a", "train")],
                               "task string, id bigint, text_a string, text_b string, label string, split string")
    tsv.write_splits(df, str(tmp_path / "s"))
    back = tsv.read_split(spark, str(tmp_path / "s"), task="t", split="train").first()
    assert back["text_a"] == text


def test_argmax_ties_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0],)], "l array<double>")
    assert [r[0] for r in df.select(ar.argmax("l")).collect()] == [1, 0]


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("t", 0, 0), ("t", 1, 0)], "task string, label_idx int, pred_idx int")
    pc = {r["class_idx"]: r["f1"] for r in mt.per_class(mt.confusion(df)).collect()}
    assert pc[1] == 0.0 and mt.macro_f1(df).first()["macro_f1"] == pytest.approx((2 / 3) / 2)


def test_zero_gradient_fgm_noop(spark):
    model = hd.LinearModel([0, 1], [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 1)], "vec_id bigint, x array<double>, y_idx int")
    # Uniform logits -> p = 0.5 each, gradient sum_c (p_c - y_c) W_c = 0 since W = 0.
    out = pt.fgm(df, model).orderBy("vec_id").collect()
    assert [list(r["x_adv"]) for r in out] == [[1.0, 2.0], [3.0, 4.0]]


def test_pgd_projection_bound(spark):
    model = hd.LinearModel([0, 1], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "vec_id bigint, x array<double>, y_idx int")
    out = pt.pgd(df, model, eps=0.5, alpha=0.3, k=3)
    tot = out.agg(F.sum(ar.sumsq(ar.sub("x_adv", "x")))).first()[0]
    assert tot ** 0.5 <= 0.5 + 1e-9


def test_freelb_row_norm_bound(spark):
    model = hd.LinearModel([0, 1], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2) for i in range(16)], "vec_id bigint, x array<double>, y_idx int")
    s = pt.freelb(df, model, (1.0, 3, 0.5, 0.3)).collect()
    assert all(r["delta_norm"] <= 0.3 + 1e-9 for r in s)


def test_task_spec_validation():
    with pytest.raises(ValueError):
        TaskSpec("bad", 0, "pair", 50, 40, 30)


def test_pgd_equals_step_by_step(spark):
    """The closed form of the moved delta's norm against plain numpy steps."""
    import numpy as np
    W, b = np.array([[1.0, 0.5], [-0.3, 1.0], [0.2, -0.7]]), np.array([0.1, 0.0, -0.2])
    x = np.array([[0.3 * i, 1.0 - 0.1 * i] for i in range(9)])
    y = np.arange(9) % 3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(9)],
                               "vec_id bigint, x array<double>, y_idx int")
    r = np.zeros_like(x)
    for _ in range(3):
        z = (x + r) @ W.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - np.eye(3)[y]) @ W
        r = r + 0.3 * g / np.linalg.norm(g)
        r *= min(1.0, 0.5 / np.linalg.norm(r))
    got = pt.pgd(df, hd.LinearModel([0, 1, 2], W, b), eps=0.5, alpha=0.3, k=3).orderBy("vec_id").collect()
    assert np.allclose([v["x_adv"] for v in got], x + r)


def test_freelb_leaves_padding_alone(spark):
    model = hd.LinearModel([0, 1], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2, int(i != 3)) for i in range(8)],
                               "vec_id bigint, x array<double>, y_idx int, mask int")
    for params in ((1.0, 3, 0.5, 0.3), (0.08, 3, 0.04, 0.0), (1.0, 1, 0.5, 0.3)):
        rows = {r["vec_id"]: r for r in pt.freelb_rows(pt.freelb(df, model, params)).collect()}
        assert rows[3]["x_adv"] == rows[3]["x"] and rows[2]["x_adv"] != rows[2]["x"]


def test_join_scores_equal_linear_scores(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0], i % 7) for i in range(60)],
                               "vec_id bigint, embedding array<double>, label int")
    cen = hd.fit_centroids(df)
    with pytest.raises(ValueError, match="too many to fetch"):
        hd.LinearModel.from_centroids(cen, max_cells=20)
    want = {r["vec_id"]: r["logits"] for r in hd.linear_score(df, hd.LinearModel.from_centroids(cen)).collect()}
    for block in (1, 3, 100):
        got = {r["vec_id"]: r["logits"] for r in hd.join_scores(df, cen, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_long_conversations_have_distinct_ids(spark):
    from braid.sources.tables import pair_id
    df = spark.createDataFrame([(c, t) for c in (0, 1, 2) for t in range(1500)], "c bigint, t bigint")
    assert df.select(pair_id(F.col("c"), F.col("t")).alias("id")).distinct().count() == 4500
    with pytest.raises(Exception, match="out of the range"):
        spark.createDataFrame([(1, 1 << 24)], "c bigint, t bigint").select(pair_id(F.col("c"), F.col("t"))).collect()


def test_vocabulary_holds_every_token(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [("t", "train", k, " ".join(words[k:] + words[:20]), None) for k in range(0, 500, 50)]
    df = spark.createDataFrame(rows, "task string, split string, id bigint, text_a string, text_b string")
    got = [(r["token"], r["n"]) for r in fe.build_vocab(df).orderBy("token_id").collect()][4:]
    count = {}
    for r in rows:
        for w in r[3].split():
            count[w] = count.get(w, 0) + 1
    assert got == sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))
    ids = [r["token_id"] for r in fe.build_vocab(df, max_size=7).collect()]
    assert sorted(ids) == list(range(11))


def test_hot_and_cold_tokens_score_alike(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("t", "train", 1, 0, ["a", "a", "b"]), ("t", "train", 2, 1, ["c", "a"]), ("t", "dev", 3, None, ["a", "b", "z", "a"])],
        "task string, split string, id bigint, label_idx int, tokens_a array<string>").withColumn(
        "tokens_b", F.lit(None).cast("array<string>"))
    dim = spark.createDataFrame([("t", "x", 0), ("t", "y", 1)], "task string, label string, label_idx int")
    scores = []
    for share in (0.0, 0.3, 2.0):  # all hot, some hot, none hot
        monkeypatch.setattr(hd, "HOT_SHARE", share)
        train = rows.filter("split = 'train'")
        model, prior = hd.fit_nb(hd.occurrences(train), train, dim, 2)
        out = hd.nb_score(rows.drop("tokens_a", "tokens_b"), hd.occurrences(rows), model, prior, 2)
        scores.append({r["id"]: r["logits"] for r in out.collect()})
    assert all(s[i] == pytest.approx(scores[0][i]) for s in scores for i in (1, 2, 3))


def test_monitor_goldens(spark):
    from braid.operators import monitor as mo
    ev = spark.createDataFrame([("r", 1, s, 0.0, f) for s, f in ((2, 0.5), (4, 0.7), (6, 0.7), (8, 0.6))]
                               + [("r", 2, s, 0.0, f) for s, f in ((2, 0.71), (4, 0.2), (6, 0.3), (8, 0.4))],
                               "run_id string, epoch bigint, step bigint, train_f1 double, dev_f1 double")
    best = mo.best_so_far(ev)
    assert [(r["flag"], r["best_f1"]) for r in best.orderBy("epoch", "step").collect()] == [
        ("*", 0.5), ("*", 0.7), (" ", 0.7), (" ", 0.7), ("*", 0.71), (" ", 0.71), (" ", 0.71), (" ", 0.71)]
    spe = spark.createDataFrame([("r", 8, 2)], "run_id string, spe bigint, n_epochs bigint")
    stop = mo.early_stop(best, spe, 5).collect()
    # The counter is 0 at global step 4, then grows by one per step (itself included): 6 at step 9.
    assert [(r["stop_epoch"], r["stop_step"], r["last_improved"]) for r in stop] == [(2, 1, 4)]
    preds = spark.createDataFrame([("r", 1, 1, "t", 0, 0), ("r", 1, 2, "t", 1, 0), ("r", 1, 3, "t", 1, 1), ("r", 1, 4, "t", 0, 0)],
                                  "run_id string, epoch bigint, step bigint, task string, label_idx int, pred_idx int")
    f1 = {r["step"]: r["f1"] for r in mo.running_f1(preds, 2).collect()}
    assert f1 == {2: pytest.approx((2 / 3) / 2), 4: pytest.approx((4 / 5 + 2 / 3) / 2)}


def test_focal_alpha_forms(spark):
    from braid.operators import losses as ls
    w = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 3.0)], "task string, label_idx int, weight double")
    form = lambda *a: [r["alpha"] for r in ls.alpha_table(w, *a).orderBy("label_idx").collect()]
    assert form() == [0.25, 0.75] and form(0.2) == [0.8, 0.2] and form(0.2, 0) == [0.2, 0.8] and form(None) == [1.0, 1.0]


def test_checkpoint_folder_must_be_shared(monkeypatch):
    from braid import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_freelb_masks_come_from_the_data(spark):
    """Members without a vector or a label, or with part of a vector, are padding; missing positions are none."""
    model = hd.LinearModel([0, 1], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    schema = "vec_id bigint, x array<double>, y_idx int"
    whole = [(0, [1.0, 2.0], 0), (1, [3.0, -1.0], 1), (3, [0.5, 0.5], 0), (8, [2.0, 2.0], 1)]
    holes = [(2, None, 1), (4, [1.0, None], 0), (5, [9.0, 9.0], None), (6, [7.0], 1), (16, None, 0)]
    keep = lambda d: d
    rows = [pt.freelb(spark.createDataFrame(r, schema), model, keep=keep).select("seq_id", "delta_norm", "adv_loss").orderBy("seq_id").collect()
            for r in (whole, whole + holes)]
    assert [r.seq_id for r in rows[0]] == [0, 1]
    assert [x for r in rows[0] for x in r] == pytest.approx([x for r in rows[1] for x in r])
    back = pt.freelb_rows(pt.freelb(spark.createDataFrame(whole + holes, schema), model, keep=keep)).collect()
    assert sorted(r.vec_id for r in back) == [0, 1, 3, 8] and all(None not in r.x_adv for r in back)
