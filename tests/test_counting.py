"""Tokens counted inside their rows: against grouping, without moving occurrences."""

import collections
import re
import sys

import pytest
from pyspark.sql import functions as F

from braid.config import TOKEN_PATTERN
from braid.functions import text as tx
from braid.operators import counting as ct
from braid.operators import features as fe
from braid.operators import gradient as gr
from braid.operators import heads as hd

ROWS = "task string, split string, id long, label_idx int, text_a string, text_b string"
DATA = [("quality", "train", 1, 0, "b a b c", None), ("quality", "dev", 2, 1, "", None), ("lang", "train", 1, 0, None, None),
        ("turns", "train", 3, 1, "x y x", "y z"), ("lang", "train", 9, 0, "a a", None), ("lang", "train", 9, 1, "a b", None),
        ("lang", "train", None, 1, "n", None), ("lang", "train", None, 0, "n m", None)]


def test_tokenizer_takes_the_tokens_of_the_pattern(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars[i:i + 16]) + " ab12中文c-٣x " for i in range(0, len(chars), 16)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    # The group of alternatives needs some stack for every letter; on runs of thousands it ended the session.
    assert df.limit(1).select(F.size(tx.tokenize(F.repeat(F.lit("ab"), 100_000)))).first()[0] == 1
    plain = F.regexp_extract_all(F.lower("t"), F.lit(TOKEN_PATTERN), 0)
    assert df.filter(tx.tokenize("t") != plain).count() == 0


def _plain(rows):
    keys = collections.defaultdict(collections.Counter)
    for task, split, i, _, a, b in rows:
        keys[task, split, i].update(re.findall(r"\w+", f"{a or ''} {b or ''}"))
    return {(*k, t): n for k, c in keys.items() for t, n in c.items()}


def test_counts_equal_grouping(spark):
    counted = ct.counted_rows(spark.createDataFrame(DATA, ROWS)).cache()
    assert counted.count() == len(DATA)
    for r in counted.collect():
        assert [(c.slot, c.cnt) for c in r.counts] == sorted((c.slot, c.cnt) for c in r.counts)
    slots = {r.token: r.s for r in ct.long_counts(counted).select("token", gr.slot_of(F.col("token"), gr.FEATURES).alias("s")).collect()}
    assert all(slots[c.token] == c.slot for r in counted.collect() for c in r.counts)
    repeated = ct.repeated_keys(counted, lambda d: d.cache())
    assert {tuple(r) for r in repeated.collect()} == {("lang", "train", 9), ("lang", "train", None)}
    alone = ct.long_counts(ct.with_keys(counted, repeated, "left_anti"))
    got = alone.unionByName(ct.grouped_counts(counted, repeated)).collect()
    assert {(r.task, r.split, r.id, r.token): r.cnt for r in got} == _plain(DATA) and len(got) == len(_plain(DATA))
    assert ct.repeated_keys(counted.filter("task <> 'lang'"), lambda d: d.cache()) is None


def test_counting_moves_nothing(spark):
    """Texts are counted where they are read; no exchange between the table and the counts."""
    plan = ct.counted_rows(spark.createDataFrame(DATA, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") <= 2


def test_vocabulary_of_counted_rows(spark):
    rows = spark.createDataFrame(DATA, ROWS)
    same = [fe.build_vocab(r).orderBy("token_id").collect() for r in (rows, ct.counted_rows(rows))]
    assert same[0] == same[1]


@pytest.mark.parametrize("some", ["id IS NOT NULL", "true"])
def test_rare_ids_travel_and_come_back(spark, monkeypatch, some):
    rows = spark.createDataFrame(DATA, ROWS).filter(some)
    vocab = fe.build_vocab(rows.filter("id <> 3")).cache()  # the tokens of row 3 are unknown
    want = {str(r) for r in fe.encode(rows, vocab).collect()}
    for hot in (0, 5, 6):
        monkeypatch.setattr(fe, "HOT_IDS", hot)
        assert {str(r) for r in fe.encode(rows, vocab).collect()} == want


@pytest.mark.parametrize("room", [0, 1000, 10**9])
def test_rare_tokens_are_broadcast_while_there_is_room(spark, monkeypatch, room):
    """1 / 2000 of all tokens was needed before, and most occurrences of a corpus were shuffled."""
    train = [("t", "train", i, i % 2, " ".join(f"w{i * 10 + j}" for j in range(10)), None) for i in range(1000)]
    rows = spark.createDataFrame([*train, ("t", "dev", 5000, None, "w0 w5 w10 zz", None)], ROWS)
    dim = spark.createDataFrame([("t", "x", 0), ("t", "y", 1)], "task string, label string, label_idx int")
    counts = hd.occurrences(fe.token_table(rows)).cache()
    model, prior = hd.fit_nb(counts.filter("split = 'train'"), rows.filter("split = 'train'"), dim, 2)
    monkeypatch.setattr(hd, "HOT_BYTES", room)
    share = hd._hot_share(model)
    assert model.filter(F.col("share") >= share).count() == (10_000 if room == 10**9 else 0)
    got = hd.nb_score(rows.select("task", "split", "id", "label_idx"), counts, model, prior, 2).filter("id = 5000").first()
    import math
    assert got.logits == pytest.approx([math.log(0.5) + 2 * math.log(2 / 15000) + math.log(1 / 15000),
                                        math.log(0.5) + math.log(2 / 15000) + 2 * math.log(1 / 15000)])
