"""The pipeline's stages by brute force on small inputs, and run() as their chain."""

import collections
import re

import pytest
from test_op3 import sets
from test_op6 import brute as mixed
from test_op7 import check as check_packing

import corpus_pipeline as cp
from braid.llm.common import stored

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def odd(spark):
    """Nulls in every column, empty texts and repeated rows among real documents."""
    words = "the of and this that with from are was not you have for but they his her she him had".split()
    text = lambda k: " ".join(words[(k * 7 + i * i) % len(words)] + str((k + i) % 9) for i in range(40))
    rows = [(k, text(k), "en", f"s{k % 3}", len(text(k))) for k in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "s1", 0), (None, text(30), "en", None, None), rows[3], rows[3],
             (3, text(40), "en", "s1", 9), (22, rows[5][1], "fr", "s2", 9), (None, rows[5][1], None, "s0", 9),
             (23, "12 34 !!", "en", "s0", 8)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_the_columns(spark, docs):
    for source in (docs, odd(spark), odd(spark).limit(0)):
        d = stored(source)
        for name, stage in cp.STAGES:
            out = stored(stage(spark, d, SF))
            if name != "pack":
                assert out.columns == d.columns, name
                assert [f.dataType for f in out.schema] == [f.dataType for f in d.schema], name
            d = out


def test_language_drops_only_what_has_no_language(spark, docs):
    gone = rows_of(docs) - rows_of(cp.language(spark, docs, SF))
    assert sum(gone.values()) <= 1
    left = rows_of(cp.language(spark, odd(spark), SF))
    gone = rows_of(odd(spark)) - left
    assert not left - rows_of(odd(spark)) and {r[0] for r in gone} == {20, 21, 23}


def groups(rows):
    s = [sets(r[1], cp.NEAR_WORDS) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= cp.NEAR_PERCENT * len(s[i] | s[j]):
                root[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i])
    return out.values()


def test_one_of_each_group_stays(spark, docs):
    for d in (docs, odd(spark)):
        rows = [tuple(r) for r in d.collect()]
        kept = rows_of(cp.near_duplicates(spark, d, SF))
        for g in groups(rows):
            stay = [r for r in g if kept[r]]
            assert sum(kept[r] for r in set(stay)) == 1
            assert stay[0][0] == min((r[0] for r in g if r[0] is not None), default=None)
        assert not set(kept) - set(rows)


def test_repeated_rows_without_words_stay(spark):
    """Whether some row with words is repeated changes nothing for the others; which one stays is fixed."""
    words = " ".join(f"w{i}" for i in range(30))
    same = [(3, words, "en", "s2", 5), (3, words, "de", "s1", 5), (3, words, "de", "s0", 5)]
    plain = [(20, "", "en", "s1", 0), (20, "", "en", "s1", 0), (None, None, None, None, None), (None, "", "en", "s0", 0),
             (None, "", "en", "s0", 0), (5, words.upper()[:60] + " other words here at all", "en", "s0", 1)]
    for order in (same, same[::-1]):
        d = stored(spark.createDataFrame(order + plain, SCHEMA).repartition(3))
        assert rows_of(cp.near_duplicates(spark, d, SF)) == collections.Counter([*plain, same[2]])


def test_secrets_are_masked_and_no_document_goes(spark, docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in cp.secrets(spark, docs, SF).collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        found = re.findall(r"(?i)token = \"([0-9a-f]{40})\"", t)
        assert all(x not in after[i].text for x in found) and after[i].n_chars == len(after[i].text)
        if not found and "password" not in t:
            assert after[i].text == t


def test_mix_takes_what_the_operator_takes(spark, docs):
    rows = docs.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    got = collections.Counter(r.doc_id for r in cp.mix(spark, docs, SF).collect())
    total = sum(size.values())
    taken = sum(size[i] * n for i, n in got.items())
    assert max(got.values()) <= 3 and total - max(size.values()) <= taken <= total
    # Sizes per source against the plain queue's targets, within the longest document.
    source = {r.doc_id: r.source for r in rows}
    want = mixed([(r.doc_id, r.source, size[r.doc_id]) for r in rows])
    for s in set(source.values()):
        of = [i for i in source if source[i] == s]
        assert abs(sum(size[i] * got[i] for i in of) - want[of[0]][1]) <= max(size.values())


def test_mix_of_repeated_rows(spark):
    d = odd(spark)
    got, before = rows_of(cp.mix(spark, d, SF)), rows_of(d)
    assert not set(got) - set(before) and all(n <= 3 * before[r] for r, n in got.items())


def test_pack(spark):
    from pyspark.sql import functions as F
    d = odd(spark)
    check_packing(cp.pack(spark, d, SF).withColumn("ids_crc32", F.crc32("ids")).collect(),
                  [(r.doc_id, r.text) for r in d.collect()])


def test_run_chains_the_stages(spark, docs):
    d = docs
    for _, stage in cp.STAGES:
        d = stored(stage(spark, d, SF))
    assert rows_of(cp.run(spark, SF)) == rows_of(d)
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "secrets", "mix", "pack"]
