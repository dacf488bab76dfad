"""Main text: parsing on fixtures, gradients by differences, held-out pages and layouts."""

import html
import re

import numpy as np
import pytest

from braid.llm import html_text as ht
from braid.llm.queries import op10_html_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def article(page):
    """Text between the article tags of the driver's template, by regular expressions."""
    body = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", "", page, flags=re.S)
    inside = re.search(r"<article>(.*)</article>", body, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inside))
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return " ".join(t for t in texts if t)


def test_query(spark, pages):
    got = {r.page_id: (r.text, r.n_chars) for r in op10_html_text(spark, SF).collect()}
    want = {i: (article(h), len(article(h))) for i, h in pages}
    assert len(got) == len(want)
    assert sum(got[i] == want[i] for i in want) / len(want) >= 0.99  # about half of them were not sampled


def test_blocks():
    page = ("<!DOCTYPE html><head><title>t</title></head><DIV Class='Side-Bar x'>a<b>b</b> c<br>d&nbsp;&eacute;<p>x<p>y</DIV>"
            "<script>var t=\"</p>\";</script>z<!-- c --> w<a href=\"a>b\">l</a><ul><li>1<li>2 &am</ul><h2>h</h3>t<!-- open")
    got = ht.blocks(page)
    assert [t for _, t, _ in got] == ["ab c d é", "x", "y", "z wl", "1", "2 &am", "h", "t"]
    assert got[0][0] == (("div", "side", "bar", "x"),) and got[2][0][-1] == ("p",) and got[3][2] == 1
    for odd in ("", "plain", "<", "<p", "<p class=\"x", "&#xZZ; &#0; &#99999999;", "</p></p>", "<script>x", "<!--"):
        ht.blocks(odd)


def test_blocks_keep_what_is_no_clutter():
    """Elements that hide text end where they end in a browser, or hide nothing."""
    texts = lambda page: [t for _, t, _ in ht.blocks(page)]
    assert texts("<head><title>t</title><body><article><p>one</p><p>two</p></article>") == ["one", "two"]
    assert texts("<head><meta charset=x><style>p{}</style><link href=y><p>one<p>two") == ["one", "two"]
    assert texts("<head><title>t</title></head><p>one") == ["one"]
    assert texts("<p>one</p><svg class=i /> <p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><math/><p>two</p><svg/><p>three") == ["one", "two", "three"]
    assert texts("<p>one <svg class='i'><title>x</title><g><text>no</text></g></svg>two") == ["one two"]
    assert texts("<p>one</p><svg><path d=z><p>two</p><div><svg></div>three") == ["one", "two", "three"]
    assert texts("<svg><foreignObject><p>one</p></foreignObject><text>no</text></svg>two") == ["one", "two"]
    assert texts("<svg><text>no</text>") == []
    for tag in ("iframe", "object", "noscript", "template", "textarea", "title"):
        assert texts(f"<p>one</p><{tag}>no</{tag}><p>two</p>") == ["one", "two"]
        assert texts(f"<p>one</p><{tag} /><p>two</p><{tag}>no</{tag}>") == ["one", "two"]
        assert texts(f"<p>one</p><{tag} id=x><p>two</p>") == ["one", "two"]
        assert texts(f"<p>one</p><{tag}-bar>two</{tag}-bar>") == ["one", "two"]
    assert texts("<object><object>no</object>no</object>one<script src=/a/>no</script><script src='b'/> two") == ["one two"]


def test_gradients():
    g = np.random.default_rng(0)
    lab = ht.Labeller()
    seqs = [g.normal(0, 1, (n, ht.PATH + ht.WORD + 3)) for n in (3, 5, 1)]
    ys = [(g.random(len(s)) < 0.5).astype(float) for s in seqs]

    def loss():
        z = lab.scores(seqs)
        return sum(np.sum(np.log1p(np.exp(z[:len(y), k])) - y * z[:len(y), k]) for k, y in enumerate(ys)) / 9
    for k, v in lab.gradients(seqs, ys).items():
        at = tuple(g.integers(0, s) for s in v.shape)
        old = lab.p[k][at]
        lab.p[k][at] = old + 1e-5
        up = loss()
        lab.p[k][at] = old - 1e-5
        down = loss()
        lab.p[k][at] = old
        assert abs((up - down) / 2e-5 - v[at]) < 1e-7


def test_other_layouts(pages):
    """Layouts drawn with another seed, from pages that were not trained on."""
    lab = ht.train([h for _, h in pages[:120]])
    others = [t for _, h in pages[120:] for _, t, _ in ht.blocks(h)]
    g, wrong, total = np.random.default_rng(99), 0, 0
    for _ in range(100):
        own = [others[int(g.integers(len(others)))] for _ in range(int(g.integers(1, 20)))]
        found = ht.blocks(ht._layout(g, own, others))
        keep = lab.content([ht.vectors(found)])[0]
        wrong, total = wrong + int((keep != (ht.labels_of(found) > 0)).sum()), total + len(found)
    assert wrong / total < 0.02


def test_edges(spark, pages):
    lab = ht.train([h for _, h in pages[:60]])
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", pages[0][1], "x"), (4, "u", pages[0][1], "x"),
            (4, "u", pages[0][1], "x"), (5, "u", long, "x"), (6, "u", "<nav><li>a</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract(df, lab).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[6] == "" and by[4] == by[None] == article(pages[0][1])
    assert by[5].startswith("word 0 word 1 ") and len(by[5].split()) == 6000
    assert ht.extract(df.limit(0), ht.fit(df.limit(0))).count() == 0


def test_sample_of_different_pages(spark, pages, monkeypatch):
    """Copies of the page with the smallest hash take one place, and whole pages are learnt."""
    monkeypatch.setattr(ht, "train", lambda found: type("Seen", (), {"p": sorted(found)})())
    some = spark.createDataFrame([(h,) for _, h in pages[:20]], "html string")
    first = some.orderBy(ht.F.xxhash64("html")).first().html
    copies = some.unionAll(spark.createDataFrame([(first,)] * 50 + [(None,)], "html string"))
    assert ht.fit(copies, 10).p == ht.fit(some, 10).p and len(ht.fit(some, 10).p) == 10


def test_learns_whole_pages(monkeypatch):
    sizes = []
    monkeypatch.setattr(ht.Labeller, "fit", lambda lab, found, labels: sizes.append([len(x) for x in found]) or lab)
    monkeypatch.setattr(ht, "LAYOUTS", 0)
    ht.train(["<article>" + "<p>word</p>" * 450 + "</article>", "<p>x"])
    assert sizes == [[200, 200, 50, 1]]


def _in_a_process(code):
    """Peak MB of a fresh process that runs ``code`` after loading the labeller."""
    import subprocess
    import sys
    out = subprocess.run([sys.executable, "-c", f"""
import resource, sys
sys.path.insert(0, {sys.path[0]!r}); sys.path[:0] = {sys.path!r}
from braid.llm import html_text as ht
{code}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"""], capture_output=True, text=True, timeout=120, check=True).stdout
    return int(out.split()[-1])


def test_long_pages_take_little_memory():
    """A 1.5 MB page of short blocks, and 20,000 open tags."""
    assert _in_a_process("""
page = "<article>" + "<p>ab</p>" * 160_000 + "</article>"
found = ht.blocks(page)
assert len(found) == 160_000
assert len(ht.main_text(ht.Labeller(), [found])) == 1""") < 500
    assert _in_a_process("""
for tag in ("div", "span", "p", "ul><li", "b"):
    found = ht.blocks(f"<{tag}>x " * 20_000)
    assert " ".join(t for _, t, _ in found).split() == ["x"] * 20_000
    ht.main_text(ht.Labeller(), [found])
ht.blocks("<div>" * 20_000 + "</span></p></b>" * 20_000 + "</div>" * 20_000)""") < 500


def test_decisions_are_those_of_the_dense_scores(pages):
    lab = ht.train([h for _, h in pages[:30]])
    found = [ht.blocks(h) for _, h in pages[30:60]] + [[]]
    kept = lab.decide([lab.terms_of(f) for f in found])
    for f, k in zip(found, kept, strict=True):
        if f:
            assert (k == (lab.scores([ht.vectors(f)])[:, 0] > 0)).all()
        assert len(k) == len(f)
