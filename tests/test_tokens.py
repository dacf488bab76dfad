"""Tokens, sequences and counts made in Arrow batches: against the JVM's expressions and plain grouping."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braid.operators import counting as ct
from braid.operators import features as fe
from braid.operators import gradient as gr
from braid.operators import heads as hd
from braid.operators import tokens as tk

ROWS = "task string, split string, id long, label_idx int, text_a string, text_b string"


def rows(n=600):
    r = random.Random(3)
    text = lambda: r.choice([None, "", "w " * r.randint(0, 300), "".join(r.choice("ab1 İ中é-\t😀_.Z\n ﻿") for _ in range(r.randint(0, 300)))])
    return [(r.choice(["turns", "quality", "lang", "other"]), r.choice(["train", "dev"]), i, r.randint(0, 2), text(), text()) for i in range(n)]


def test_every_character_has_its_kind(spark):
    """Every code point between letters: the tokens of the JVM's expression, counted without it."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars[i:i + 64]) + " ab12中文c-٣x " for i in range(0, len(chars), 64)]
    df = spark.createDataFrame([("lang", "train", i, 0, t, None) for i, t in enumerate(texts)], ROWS).repartition(4).localCheckpoint()
    counted = ct.counted_rows(df)
    assert "regexp" not in counted._jdf.queryExecution().executedPlan().toString()
    want = fe.token_table(df).select("id", F.array_sort("tokens_a").alias("t"))
    got = counted.select("id", F.array_sort(F.flatten(F.transform("counts", lambda x: F.array_repeat(x["token"], x["cnt"].cast("int"))))).alias("t"))
    assert want.exceptAll(got).isEmpty() and got.count() == len(texts)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_texts_are_cut_anywhere(spark, monkeypatch, piece):
    monkeypatch.setattr(tk, "PIECE", piece)
    texts = [r[4].lower() if r[4] is not None else None for r in rows(60)]
    table = np.frombuffer(tk.kinds(spark).value, np.uint8)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text_a string")
    want = [r.t for r in df.select("i", fe.tx.tokenize("text_a").alias("t")).orderBy("i").collect()]
    for kind in (pa.string(), pa.large_string()):
        words, size = tk.tokens_of(pa.array(["zz", *texts], kind).slice(1), table)
        assert words.to_pylist() == [t for w in want for t in w] and size.tolist() == [len(w) for w in want]
    assert tk.tokens_of(pa.array([], pa.string()), table)[0].to_pylist() == []


def test_sequences_equal_the_expressions(spark):
    df = spark.createDataFrame(rows(), ROWS).repartition(3).localCheckpoint()
    cols = ["task", "split", "id", "label_idx", "seq", "len_a", "len_b", "max_length", "is_pair"]
    want = {str(r) for r in fe.sequences(df).select(cols).collect()}
    assert {str(r) for r in ct.framed_rows(df).select(cols).collect()} == want


def test_packed_counts_are_the_features(spark):
    counted = ct.counted_rows(spark.createDataFrame(rows(), ROWS).repartition(3)).localCheckpoint()
    want = {r.id: (r.slot, r.value) for r in gr.counted_features(counted, gr.FEATURES).select("id", "slot", "value").collect()}
    got = counted.select("id", "packed").toArrow().combine_chunks()
    size, slot, value = gr.unpacked(got["packed"].chunk(0))
    edge = np.concatenate([[0], np.cumsum(size)])
    for k, i in enumerate(got["id"].to_pylist()):
        assert slot[edge[k]:edge[k + 1]].tolist() == want[i][0] and value[edge[k]:edge[k + 1]].tolist() == want[i][1]


def test_rows_are_scored_alike_packed_or_not(spark):
    counted = ct.counted_rows(spark.createDataFrame(rows(200), ROWS).repartition(3)).localCheckpoint()
    none = F.lit(None)
    own = counted.select(F.when(F.col("id") % 3 == 0, "dev").otherwise("train").alias("kind"), "task", "split", "id", "label_idx",
                         none.cast("long").alias("epoch"), none.cast("long").alias("step"), none.cast("array<int>").alias("slot"),
                         none.cast("array<double>").alias("value"), "packed")
    open_ = gr.counted_features(counted, gr.FEATURES).select("id", F.col("slot").alias("_s"), F.col("value").alias("_v"))
    plain = own.join(open_, "id").withColumn("slot", F.col("_s")).withColumn("value", F.col("_v")).drop("_s", "_v", "packed")
    classes = {"turns": 3, "quality": 3, "lang": 70, "other": 3}
    g = np.random.default_rng(0)
    heads = {t: g.normal(size=(gr.FEATURES + 1, n)) for t, n in classes.items()}
    mixed = own.filter("id % 2 = 0").unionByName(plain.filter("id % 2 = 1").withColumn("packed", none.cast("binary")))
    a, b = ({(r.kind, r.task, r.id): r.logits for r in gr.scored(x, heads).filter("kind <> 'grad'").collect()} for x in (plain, mixed))
    assert a.keys() == b.keys() and len(a) == 200 and all(np.allclose(a[k], b[k]) for k in a)
    ga, gb = (gr.mean_gradient(gr.scored(x, heads).localCheckpoint(), classes, gr.FEATURES) for x in (plain, mixed))
    assert all(np.allclose(ga[t], gb[t]) and ga[t].any() for t in classes)


@pytest.mark.parametrize("room", [0, 3000, 10**9])
def test_counted_rows_are_scored_as_their_occurrences(spark, monkeypatch, room):
    monkeypatch.setattr(hd, "HOT_BYTES", room)
    df = spark.createDataFrame(rows(), ROWS).filter("task <> 'other'").repartition(3)
    counted = ct.counted_rows(df).localCheckpoint()
    long = ct.long_counts(counted)
    plain = collections.Counter()
    for r in long.filter("split = 'train'").collect():
        plain[r.task, r.token, r.label_idx] += r.cnt
    totals = collections.Counter()
    for r in hd.nb_totals(counted.filter("split = 'train'")).collect():
        totals[r.task, r.token, r.label_idx] += r.cnt
    assert totals == plain
    dim = spark.createDataFrame([(t, str(k), k) for t in ("turns", "quality", "lang") for k in range(3)], "task string, label string, label_idx int")
    train = counted.filter("split = 'train'")
    model, prior = hd.fit_nb(hd.nb_totals(train), train, dim, 3)
    model, prior = model.localCheckpoint(), prior.localCheckpoint()
    want = {(r.task, r.split, r.id, r.label_idx): r.logits for r in hd.nb_score(counted, long, model, prior, 3).collect()}
    keep = lambda d, by=(): d.localCheckpoint()
    got = {(r.task, r.split, r.id, r.label_idx): r.logits for r in hd.nb_score_counted(counted, model, prior, 3, keep).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_rows_skipped_by_a_block_open_no_arrays(spark):
    """All rows' counts became arrays of numbers and were normed before a block picked its rows."""
    from braid.plans.training import Training
    from tests.conftest import SF001
    t = Training(spark, SF001)
    plan = t.part_rows(t.features(), t.cuts(), 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in plan and "aggregate(" not in plan and "packed" in plan
