"""Raw TSV routing and the streaming monitors."""

import pytest
from pyspark.sql import functions as F

from braid.config import TASKS
from braid.operators import metrics as mt
from braid.sources import tsv
from braid.streaming import running as rs


def test_route_sources(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "quality_train.csv").write_text("1\tgood text\tq1t0\n2\tbad\tq0t1\n")
    (d / "quality_a.csv").write_text("3\tunlabelled\n")
    (d / "turns_train.csv").write_text("4\thello\tthere\tuser>assistant\n")
    (d / "lang_test.csv").write_text("5\tbonjour\n")
    (d / "other.txt").write_text("ignored\n")
    df = tsv.route_sources(spark, str(d), TASKS)
    got = {(r["task"], r["kind"], r["id"], r["label"]) for r in df.collect()}
    assert got == {("quality", "labelled", 1, "q1t0"), ("quality", "labelled", 2, "q0t1"),
                   ("quality", "test", 3, None), ("turns", "labelled", 4, "user>assistant"),
                   ("lang", "test", 5, None)}


@pytest.mark.parametrize("line", ["1\ttext\tlabel\tmore", "1\ttext", "x\ttext\tlabel"])
def test_malformed_rows_fail(spark, tmp_path, line):
    (tmp_path / "lang_train.csv").write_text(f"7\tfine\ten\n{line}\n")
    df = tsv.route_sources(spark, str(tmp_path), TASKS)
    with pytest.raises(Exception, match="(?i)malformed"):
        df.select("task", *(["id"] if line[0] == "x" else [])).collect()


def test_missing_files_and_odd_texts(spark, tmp_path):
    (tmp_path / "lang_train.csv").write_text('7\t "quoted" \\ text \ten\n')
    (tmp_path / "note.txt").write_text("no data")
    rows = tsv.route_sources(spark, str(tmp_path), TASKS).collect()
    assert [(r["task"], r["id"], r["text_a"], r["label"]) for r in rows] == [("lang", 7, ' "quoted" \\ text ', "en")]


def test_header_tsv_round_trip(spark, tmp_path):
    rows = [("t", 1, ' say "hi" \\n ', None, "a", "train"), ("t", 2, "é", "b", "a", "dev")]
    df = spark.createDataFrame(rows, "task string, id bigint, text_a string, text_b string, label string, split string")
    out = str(tmp_path / "s")
    tsv.write_splits(df, out, "tsv")
    back = tsv.read_split(spark, out, split="dev", fmt="tsv", schema=df.schema).collect()
    assert [(r["id"], r["text_a"], r["text_b"]) for r in back] == [(2, "é", "b")]
    assert tsv.read_split(spark, out, split="train", fmt="tsv", schema=df.schema).first()["text_a"] == ' say "hi" \\n '
    for bad in ("a\tb", "a\nb"):
        with pytest.raises(Exception, match="tab or a line break"):
            tsv.write_splits(df.withColumn("text_a", F.lit(bad)), str(tmp_path / "x"), "tsv")


def test_score_stream_equals_batch(spark, tmp_path):
    from braid.operators import heads as hd
    df = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(40)], "vec_id bigint, embedding array<double>")
    model = hd.LinearModel([0, 1], [[1.0, 0.0], [0.0, 2.0]], [0.0, 0.0])
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df.repartition(4).write.parquet(src)
    rs.run_score_stream(spark, src, df.schema, model, out, str(tmp_path / "ck"), 1)
    got = {r["vec_id"]: r["pred_idx"] for r in spark.read.parquet(out).collect()}
    assert got == {i: int(i % 4 < 2) for i in range(40)} | {i: 0 for i in range(40) if i % 4 == 2}


def test_stream_metrics_and_session_settings(spark, tmp_path):
    rows = [("t", "dev", i, i % 3, (i * 7) % 3 if i % 5 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "task string, split string, id bigint, label_idx int, pred_idx int")
    src, met = str(tmp_path / "src"), str(tmp_path / "met")
    df.repartition(3).write.parquet(src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rs.run_running_confusion(spark, src, df.schema, str(tmp_path / "out"), str(tmp_path / "ck"), 1, met)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    got = rs.current(spark, met).first()
    assert got["accuracy"] == mt.accuracy(df, ["task", "split"]).first()["accuracy"]
    assert got["macro_f1"] == pytest.approx(mt.macro_f1(df, ["task", "split"]).first()["macro_f1"])


def test_stream_confusion_equals_batch(spark, tmp_path):
    rows = [("t", "dev", i, i % 3, (i * 7) % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "task string, split string, id bigint, label_idx int, pred_idx int")
    src = str(tmp_path / "src")
    df.repartition(5).write.parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    rs.run_running_confusion(spark, src, df.schema, out, ck)
    got = {(r["label_idx"], r["pred_idx"], r["n"]) for r in rs.current(spark, out).collect()}
    want = {(r["label_idx"], r["pred_idx"], r["n"]) for r in mt.confusion(df, ["task", "split"]).collect()}
    assert got == want


def test_a_replayed_batch_writes_the_same_table(spark, tmp_path):
    """A run that dies before its last batch is committed does that batch again."""
    import glob
    import os
    rows = [("t", "dev", i, i % 4, (i * 7) % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "task string, split string, id bigint, label_idx int, pred_idx int")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    df.repartition(6).write.parquet(src)
    rs.run_running_confusion(spark, src, df.schema, out, ck, 2)
    want = sorted(map(tuple, mt.confusion(df, ["task", "split"]).collect()))
    cells = lambda: sorted((r["task"], r["split"], r["label_idx"], r["pred_idx"], r["n"]) for r in rs.current(spark, out).collect())
    assert cells() == want and rs.versions(spark, out) == [0, 1, 2]
    commits = sorted(glob.glob(f"{ck}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(commits[-1])
    crc = os.path.join(ck, "commits", f".{os.path.basename(commits[-1])}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    # A half-written version is not read.
    os.makedirs(f"{out}/v=9")
    rs.run_running_confusion(spark, src, df.schema, out, ck, 2)
    assert cells() == want and rs.versions(spark, out) == [0, 1, 2]


def test_log_lines_do_not_double(spark, tmp_path):
    from braid.operators import monitor as mo
    path = str(tmp_path / "log")
    lines = spark.createDataFrame([("r", 1, 5, "a"), ("r", 1, 10, "b"), ("r", 2, 5, "c")], "run_id string, epoch long, step long, line string")
    mo.append_log(lines.filter("epoch = 1"), path)
    mo.append_log(lines.filter("step = 5"), path)
    mo.append_log(lines.filter("step = 5"), path)
    assert sorted(map(tuple, mo.read_log(spark, path).collect())) == sorted(map(tuple, lines.collect()))
