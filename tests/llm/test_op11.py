"""Source divergence against a plain count."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from braid.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, least=10, top=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        t = terms_of(text)
        docs[lang or ""].update(set(t))
        counts[lang or "", source or ""].update(t)
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least}
        mine = {s: {t: n for t, n in c.items() if t in kept} for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in mine.values():
            whole.update(c)
        def p(c, t, v=len(kept)):
            return 1 + 1_000_000_000 * (c.get(t, 0) + 2) // (sum(c.values()) + 2 * v)
        def f(x, y):
            return (x - y) ** 2 // (x + y)
        for s, c in mine.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in mine.items() if x != s]
            used = [(f(p(c, t), p(whole, t)), t) for t in c if p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", used)):
                found.sort(key=lambda e: (-e[0], e[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def rows_of(n, seed=3, langs=("en", "de", None, "én"), sources=7):
    g = np.random.default_rng(seed)
    vocab = ["Ab", "ab", "été", "x y", "漢字", "don't", "zz9zz", *[f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(60)]]
    out = []
    for i in range(n):
        source = f"s{g.integers(sources)}" if g.random() < 0.9 else None
        at = np.minimum(g.geometric(0.06, g.integers(0, 40)) + (3 * int((source or "s0")[1:])), len(vocab) - 1)
        out.append((i, None if g.random() < 0.05 else " \n".join(vocab[k] for k in at), langs[g.integers(len(langs))], source))
    return out


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.mark.parametrize("kw", [
    {},
    # Small texts at a time, parts, slices, few counters, small tiles: every path is taken.
    dict(limit=40, part_bytes=60, slice_bytes=1500, most=30, block_sources=2),
])
def test_against_plain(spark, kw):
    rows = rows_of(260)
    assert run(spark, rows, **kw) == plain(rows)


def test_equal_hashes(spark):
    """A hash under which most terms are alike changes nothing."""
    def weak(buf, start, end):
        return divergence.term_hash(buf, start, end) % np.uint64(5) << np.uint64(61)
    rows = rows_of(120)
    assert run(spark, rows, hashing=weak, part_bytes=300) == plain(rows)


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(1, "rare words", "xx", "a"), (2, None, "xx", None), (2, "", "xx", "b"), (None, "1 2 3", None, "c")]
    assert run(spark, rows) == plain(rows)
    # Repeated rows are documents; ties go to the smaller item; a long text counts once as a document.
    rows = [(1, "tie eit", "en", "a")] * 9 + [(2, "tie eit " * 400_000, "en", "b"), (3, "other", "en", "b"), (4, "x" * 3_000_000, "en", "c")]
    got = run(spark, rows)
    assert got == plain(rows) and ("en", "a", "pair", "b") in {r[:4] for r in got}
    clash = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", term string, n int, part int")
    assert sorted(tuple(r) for r in divergence.divergence(clash).collect()) == got


def test_perfect_hash():
    g = np.random.default_rng(1)
    keys = g.integers(0, 2**63, 20_000).astype(np.uint64)
    keys[:3] = keys[3]  # equal hashes never part
    index = divergence.PerfectHash(keys)
    slot, many = index.find(keys[3:])
    assert index.n == len(keys) and sorted(index.slot) == list(range(len(keys)))
    assert many[0] == 4 and (many[1:] == 1).all() and (slot[1:] == index.slot[4:]).all()


def test_foreign_terms_have_no_slot():
    part = divergence.Part([b"abc", b"abd", "é".encode()])
    t = divergence.Terms([b"abc ABD xyz", "É é".encode()])
    slots = part.slots(t, np.arange(len(t.first)))
    found = {t.low[t.start[k]:t.start[k] + t.size[k]].tobytes(): s for k, s in zip(t.first, slots, strict=True)}
    assert found[b"xyz"] == -1 and found["É".encode()] == -1
    assert sorted([found[b"abc"], found[b"abd"], found["é".encode()]]) == [0, 1, 2]


def test_shares_are_exact():
    for n, total, terms in ((0, 0, 1), (7, 11, 3), (10**13, 3 * 10**13, 10**8), (9, 10**15, 5)):
        assert divergence.share(np.array([n]), total, terms)[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_long_text_is_cut_between_terms():
    text = ("abc déf " * 500 + "x" * 900 + ".tail").encode()
    pieces = list(divergence.cut(text, 100))
    assert b"".join(pieces) == text and max(map(len, pieces)) <= 1000
    assert sum((terms_of(p.decode()) for p in pieces), []) == terms_of(text.decode())
