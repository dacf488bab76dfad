"""Packing: ids against the tokenizer on whole texts, best fit against a plain search."""

import collections
import zlib

import numpy as np
import pytest

from braid.llm import packing
from braid.llm.queries import op7_packing

SF = "/root/testdata/sf0.01"


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_path())


def check(rows, docs, least_fill=None):
    """Pieces partition each document's ids; sequences are gapless and within the limit."""
    tok = tokenizer()
    texts = collections.defaultdict(list)
    for i, t in docs:
        texts[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    want = collections.Counter()
    for i, all_ids in texts.items():
        for ids in all_ids:
            for s in range(0, len(ids), 4096):
                part = ids[s:s + 4096]
                want[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096
    if least_fill:
        assert sum(r.length for r in rows) / (4096 * len(seqs)) > least_fill


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op7_packing(spark, SF).collect(), docs, least_fill=0.98)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 5)  # the tables are emptied again and again
    monkeypatch.setattr(packing, "DOCS_PER_GROUP", 4)
    odd = ["", None, "  \n\t ", "Don't stop, it's 3.5%%% A-b_c!!", "É É H̱ İstanbul ΣΑΣ ς K ﬁ x​y",
           "a b　c d\x1fe\x85f", "l'été, l’été d'Été 'S 's! x's", "日本語 テスト ٣٤ ½", "<|endoftext|> ok",
           "word " * 30_000, "word " * 30_000, "x" * 20_000, "😀👍🏽 éÉ", "...'''...", "''s's"]
    docs = [*enumerate(odd), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, offset int, start int")
    pieces = packing.tokenise(df).selectExpr("doc_id", "start", "length", "doc_tokens", "crc32(ids) ids_crc32")
    check(packing.pack(pieces, len(docs)).collect(), docs)
    assert packing.pack(packing.tokenise(df.limit(0)), 0).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    g = np.random.default_rng(seed)
    lengths = g.integers(1, 65, 400)
    sequence, offset = packing.best_fit_decreasing(lengths, 64)
    rooms, want = [], []
    for n in -np.sort(-lengths):
        fits = [(r, s) for s, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(64)
            fits = [(64, len(rooms) - 1)]
        r, s = min(fits)
        want.append(64 - r)
        rooms[s] -= n
    assert sorted(offset[np.argsort(-lengths, kind="stable")]) == sorted(want) and sequence.max() + 1 == len(rooms)


def test_equal_ids_spread_over_groups(spark):
    """Rows that share an id, or have none, are no group of their own."""
    from pyspark.sql import functions as F
    for i in (None, 7):
        pieces = spark.createDataFrame([(i, 0, 100, 100)] * 20_000, "doc_id long, start long, length long, doc_tokens long").repartition(8)
        rows = packing.pack(pieces, 20_000).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
        many = sorted(r["count"] for r in rows)
        assert len(many) == 10 and many[-1] <= 2 * many[len(many) // 2]
