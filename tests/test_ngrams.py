"""Hashed n-grams (H4): md5 by columns, buckets against a plain version, every n-gram hashed once."""

import hashlib

import numpy as np
import pyarrow as pa

from braid.operators import heads as hd
from braid.operators import ngrams as ng

# A token of each length around the 64-byte blocks, letters of several bytes, and one longer than what is hashed together.
LONG = [("x" * n) for n in range(1, 330)] + ["ж" * 40, "語", "é" * 64, "y" * 5000]


def bucket(gram, buckets):
    return int(hashlib.md5(" ".join(gram).encode()).hexdigest()[:8], 16) % buckets


def plain(tokens, n, buckets):
    return sorted({bucket(tokens[i:i + n], buckets) for i in range(len(tokens) - n + 1)})


def test_hashes_are_md5():
    pieces = [t.encode() for t in LONG] + [b""]
    ends = np.cumsum([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces) + bytes(64 * ng.MOST_BLOCKS), np.uint8)
    length = np.array([len(p) for p in pieces], np.int32)
    assert ng.hashes(text, ends - length, length).tolist() == [int(hashlib.md5(p).hexdigest()[:8], 16) for p in pieces]


def test_buckets_equal_plain_version(monkeypatch):
    monkeypatch.setattr(ng, "TOGETHER", 50)  # rows go over several groups of n-grams
    rows = [LONG, [], None, ["a"], ["a", "b"], ["a", "b"] * 60, ["", " ", "a b", ""], LONG[::-1]]
    given = pa.array([["left out"], *rows], pa.list_(pa.string()))[1:]
    for buckets in (128, 1, 2**33):
        got = ng.buckets_of(given, (1, 2, 5), buckets)
        for n, b in zip((1, 2, 5), got, strict=True):
            assert b.to_pylist() == [plain(r or [], n, buckets) for r in rows]
    for none in ([], [[], None]):
        assert ng.buckets_of(pa.array(none, pa.list_(pa.string())), (2,), 128)[0].to_pylist() == [[]] * len(none)


def test_features_of_odd_texts(spark):
    texts = ["", None, "one", "Two Words", "語言 and, MORE words; " * 30, "w" * 3000 + " tail of it", "a b c d e f", "a b c d e f"]
    rows = [(i if i else None, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text_a string, text_b string")
    f = hd.ngram_features(df)
    assert f.dtypes == [("id", "bigint"), *((f"b{n}", "array<bigint>") for n in (2, 3, 4, 5))]
    got = {r["id"]: r for r in f.collect()}
    words = {0: [], 1: [], 2: ["one"], 3: ["two", "words"], 4: ["語", "言", "and", ",", "more", "words", ";"] * 30,
             5: ["w" * 3000, "tail", "of", "it"], 6: list("abcdef"), 7: list("abcdef")}
    assert len(got) == len(texts)
    for i, w in words.items():
        for n in (2, 3, 4, 5):
            assert list(got[i or None][f"b{n}"]) == plain(w, n, 128)
    assert hd.ngram_features(df.limit(0)).count() == 0


def test_features_leave_no_per_gram_expression(spark):
    """Failed before: the plan joined, hashed and converted n-grams one by one in interpreted lambdas, 5 microseconds each."""
    df = spark.createDataFrame([(1, "a b c")], "id bigint, text_a string")
    plan = hd.ngram_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "lambdafunction" not in plan and plan.count("regexp_extract_all") == 1
