"""Language identification: features by counting, codes, held-out accuracy."""

import zlib

import numpy as np
import pytest

from braid.llm import langid
from braid.llm.queries import op8_language_id

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = op8_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert len(out) > 1000 and sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.98


def test_features_do_not_cross_texts():
    texts = [b"Hello, World", b"", b"ab", "é1x".encode(), b"   ", b"hello world"]
    together = langid.features(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(row, langid.features([t])[0])
    assert (together[1] == 0).all() and (together[2] == 0).all() and (together[4] == 0).all()


@pytest.mark.parametrize("languages", [1, 2, 4, 7, 12])
def test_codewords_differ(languages):
    code = langid.codewords(languages)
    assert code.shape[0] == languages and set(np.unique(code)) <= {-1, 1}
    gaps = [(code[i] != code[j]).sum() for i in range(languages) for j in range(i)]
    # Exhaustive codes: any two differ in half of the columns; others: by several bits.
    assert not gaps or min(gaps) >= (2 ** (languages - 2) if 2 < languages <= 7 else 1 if languages == 2 else 8)


def test_code_corrects_a_wrong_bit():
    """One classifier turned around does not change the decision."""
    m = langid.train(["aaa bbb aab"] * 20 + ["ccc ddd ccd"] * 20 + ["eee fff eef"] * 20 + ["ggg hhh ggh"] * 20,
                     ["a"] * 20 + ["c"] * 20 + ["e"] * 20 + ["g"] * 20)
    x = langid.features([b"aab bbb", b"ccd ddd", b"eef fff", b"ggh hhh"])
    assert list(m.decode(x)[0]) == [0, 1, 2, 3]
    for bit in range(m.code.shape[1]):
        m.w[:, bit] *= -1
        m.b[bit] *= -1
        assert list(m.decode(x)[0]) == [0, 1, 2, 3]
        m.w[:, bit] *= -1
        m.b[bit] *= -1


def test_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "", "fr"),
            (5, "12 34 !?", "en"), (6, "½ ² _", None), (7, "the dog " * 50_000, None), (None, "le chien", "fr"),
            (1, "the cat sat on the mat", "en"), (8, "日本語", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    out = langid.identify(df, langid.fit(df)).collect()
    got = {(r.doc_id, r.text and r.text[:8]): r for r in out}
    assert len(out) == len(rows) and out[0].lang == "en"
    assert got[1, "the cat "].lang_pred == got[7, "the dog "].lang_pred == "en"
    assert got[2, "le chat "].lang_pred == got[None, "le chien"].lang_pred == "fr"
    for k in ((3, None), (4, ""), (5, "12 34 !?"), (6, "½ ² _")):
        assert (got[k].lang_pred, got[k].score, got[k].ambiguous) == ("und", 0.0, True)
    assert got[8, "日本語"].lang_pred in ("en", "fr")
    nothing = langid.identify(df, langid.fit(df.filter("lang = 'xx'"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    one = langid.identify(df, langid.fit(df.filter("lang = 'fr'"))).collect()
    assert {r.lang_pred for r in one} == {"fr", "und"}
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0


def test_repeated_rows_lose_no_language(spark):
    """A language of copies of one text is learnt, and its copies are drawn once."""
    import pyspark.sql.functions as F
    g = np.random.default_rng(4)
    french = [" ".join(g.choice("le la maison rouge dans une petite ville avec des gens".split(), 12)) for _ in range(600)]
    for text in ("the house on the hill", "when the winter came", "of all the letters"):
        rows = [(i, text, "en") for i in range(600)] + [(600 + i, t, "fr") for i, t in enumerate(french)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.fit(docs, sample=60)
        assert model.languages == ["en", "fr"]
        told = langid.identify(docs, model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"))
        assert all(r.a > 0.95 for r in told.collect())


def test_many_languages(spark):
    """Only the commonest are learnt, whatever a dirty column holds."""
    rows = [(f"text of number {i}", f"x{i}") for i in range(300)] + [(f"le texte {i}", "fr") for i in range(40)] + [(f"das wort {i}", "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert langid.fit(docs, most=2).languages == ["de", "fr"]
