"""Fingerprints: every column against a plain Python computation."""

import collections
import hashlib
import re

import numpy as np

from braid.llm import fingerprints as fp
from braid.llm.queries import op2_fingerprints

SF = "/root/testdata/sf0.001"


def bag(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    keys = a.keys() | b.keys()
    if not keys:
        return 1.0
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(docs)
    near = []
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1], strict=True):
        e = a[:len(a) - len(a) // 4] + b[:len(a) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        own, other, nxt = fp.fingerprint_texts([a]), fp.fingerprint_texts([e]), fp.fingerprint_texts([b])
        assert [r.fingerprint] == fp.to_text(own) and [r.edited_fingerprint] == fp.to_text(other)
        assert r.near_edited == fp.likeness(own, other)[0] and r.near_next == fp.likeness(own, nxt)[0]
        near += [r.near_edited - jaccard(a, e), r.near_next - jaccard(a, b)]
    return near


def test_query(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = check(op2_fingerprints(spark, SF), docs)
    assert abs(np.mean(near)) < 0.01 and np.max(np.abs(near)) < 0.25


def test_weights_count():
    # One word over and over: a single term, so only the weights tell the texts apart.
    a, b = ("x " * 14).strip(), ("x " * 34).strip()  # weights 10 and 30
    own = fp.fingerprint_texts([a, b], 1024)
    assert abs(fp.likeness(own[:1], own[1:])[0] - 1 / 3) < 0.05


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BLOCK", 3)
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(5, ""), (1, None), (2, "a b"), (3, "a b"), (4, long), (9, " \t "), (7, "x y z q r s"), (None, "é ü"),
            (-3, "One two three four five six"), (11, "one TWO three four five six")]
    df = spark.createDataFrame([(t, "b", 1, "f", i) for i, t in rows],
                               "text string, block string, tail int, fingerprint string, doc_id long")
    check(fp.edited_neighbours(df.repartition(4)), [(i, t or "") for i, t in rows])
    f = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert f[2] == f[3] and f[5] == f[1] == f[9] and f[-3] == f[11] != f[7]
    empty = df.limit(0)
    assert fp.edited_neighbours(empty).count() == 0 and fp.fingerprints(empty).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "b c"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "z")], "doc_id long, text string")
    rows = fp.edited_neighbours(df).collect()
    assert sorted(r.n_chars for r in rows) == [1, 3, 11, 11]
    assert len({r.fingerprint for r in rows if r.n_chars == 11}) == 1
