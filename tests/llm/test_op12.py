"""Quality classifier: held-out accuracy, features against plain compression, odd input."""

import numpy as np
import pytest
import zstandard as zstd

from braid.llm import quality
from braid.llm.queries import op12_quality_classifier
from pyspark.sql import functions as F

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"
WORDS = [a + b for a in "ri sto hou win let sma gre bro ta lin mo fer".split() for b in "ver ne se ter ll en wn".split()]


def prose(g, n=60):
    return " ".join(g.choice(WORDS, n)) + "."


def junk(g, n=60):
    return " ".join(w.upper() + "!!" for w in g.choice(WORDS, n))


def table(spark, n=160, seed=1):
    g = np.random.default_rng(seed)
    rows, told = [], []
    for i in range(n):
        good = i % 4 != 0
        rows.append((i, prose(g) if good else junk(g)))
        told.append((i, int(good)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(told, LABELS)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op12_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"),
                 F.avg(F.when(F.col("quality") == 0, F.col("predicted"))).alias("bad_kept"),
                 F.avg(F.pow(F.col("score") - F.col("quality"), 2)).alias("brier"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 500 and r.right >= 0.97 and r.bad_kept <= 0.15 and r.brier <= 0.03


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark)
    held = quality.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs.filter(~held), x) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.good == b.good and a.bad == b.bad
    got = quality.score(docs, a).join(labels, "doc_id").filter(held)
    assert got.filter("predicted <> quality").isEmpty()


def test_features_against_plain_compression(spark):
    g = np.random.default_rng(2)
    model = quality.Model(0.5, quality.dictionary([prose(g).encode()] * 50), b" ".join([junk(g).encode()] * 5))
    text = (prose(g, 400) + junk(g, 20) + "é" * 30).encode()

    def size(data, held):
        c = zstd.ZstdCompressor(compression_params=quality.parameters(), dict_data=zstd.ZstdCompressionDict(held) if held else None)
        return len(c.compress(data))
    cuts = [text[a:a + 512] for a in range(0, len(text), 512)]
    good, bad, plain = ([size(c, d) for c in cuts] for d in (model.good, model.bad, b""))
    large = [k for k, c in enumerate(cuts) if len(c) >= 128]
    gap = [(x - y) / max(x, y) for x, y in zip(good, bad, strict=True)]
    assert np.allclose(model.features(cuts), [
        (sum(good) - sum(bad)) / sum(map(max, good, bad)), max(gap[k] for k in large), min(gap[k] for k in large),
        -np.log(min(plain[k] / len(cuts[k]) for k in large))])


def test_score_rises_with_good_text(spark):
    g = np.random.default_rng(3)
    docs, labels = table(spark)
    model = quality.fit(docs, labels)
    got = [model.score(t.encode()) for t in (junk(g, 200), prose(g, 100) + junk(g, 100), prose(g, 200))]
    assert got[0] < got[2] and got[1] < got[2] and got[0] < 0.2 and got[2] > 0.8


@pytest.mark.parametrize("many", [1, 5])
def test_repeated_rows_change_nothing(spark, many):
    docs, labels = table(spark)
    again = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(many)))).drop("k").repartition(7)
    a, b = quality.fit(docs, labels), quality.fit(again, labels)
    assert (a.weights == b.weights).all() and a.share == b.share


def test_edges(spark):
    docs, labels = table(spark, 40)
    odd = spark.createDataFrame([(1001, None), (1002, ""), (None, "x"), (1003, "a" * 2_000_000), (1, "é")], DOCS)
    more = spark.createDataFrame([(1001, 1), (1002, 0), (None, 1), (7, None), (8, 5)], LABELS)
    model = quality.fit(docs.unionByName(odd), labels.unionByName(more))
    rows = quality.score(odd.withColumns({"score": F.lit("x"), "windows": F.lit(1)}), model).collect()
    assert [r.asDict().keys() for r in rows][0] == {"doc_id", "text", "windows", "score", "predicted"}
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert by[1001].score == by[1002].score == model.share
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    for y in (0, 1):  # one label only
        one = quality.fit(docs, labels.filter(F.col("quality") == y))
        assert {(r.score, r.predicted) for r in quality.score(docs, one).collect()} == {(float(y), y)}
    assert quality.score(docs.limit(0), model).collect() == []
    few = quality.fit(docs.limit(8), labels)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, few).collect())
