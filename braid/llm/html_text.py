"""Main text of HTML pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks: runs of text between block-level
tags.  Each block becomes a vector of hashed tokens of its tag path (tags,
classes and ids of all open elements), hashed words, and a few lengths.  A
bidirectional LSTM in numpy reads the whole sequence of a page and classifies
every block; the blocks it calls content are joined.

The labeller is trained here, on a bounded sample of different pages (``SAMPLE_PAGES``),
each from its first block to its last, in pieces of ``PIECE_BLOCKS``.
Blocks of these are labelled by their containers: inside one of ``CONTENT`` and
inside none of ``CLUTTER``.  Every sampled page is also laid out anew a few times,
with other container names, and with notices, forms, adverts, sidebars and
comments made of other pages' paragraphs, so the labels do not hang on one
template.  Prediction sees no label and reads every page whole.

Defined results.  Null or empty html: empty text.  Comments, scripts, styles,
titles, text areas, frames, templates, objects and drawings hold no blocks.  The
head ends where its last possible child does, closed or not.  An unclosed comment,
script, style or tag runs to the end of the page; any other of these elements that
is self-closed or never closed hides nothing, and an open drawing ends at the first
HTML element that cannot be part of it.  Equal html, equal text.  Repeated rows stay.  Extra columns are
ignored; the empty table gives an empty result.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .textkernel import BYTE_LOWER, prefix_hash, span_hash, words

SAMPLE_PAGES = 240
LAYOUTS = 8  # new layouts of each sampled page
PIECE_BLOCKS = 200  # longer pages are learnt in pieces
PATH, WORD, HIDDEN = 512, 32, 16
EPOCHS, BATCH, RATE, SEED = 16, 32, 0.02, 11
# Pages and their blocks labelled together, blocks whose vectors are made at once, and steps x pages of a run.
PAGES_AT_ONCE, BLOCKS_AT_ONCE = 256, 8192
VECTORS_AT_ONCE, STEPS_AT_ONCE = 2048, 1 << 16

# HTML element names, and the names that containers of article
# text and of everything else commonly have (tags, and words of class and id).
BLOCK_TAGS = set("""address article aside blockquote body button caption center dd details dialog div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol
    optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
# Their content is raw text up to their end tag; the first two run to the end of the page without one.
RAW_TAGS = "script style title textarea iframe noscript".split()
HIDDEN_TAGS = {"template", "object"}  # these nest
FOREIGN_TAGS = {"svg", "math"}
# What ends an open drawing or formula, as browsers do; none of these is an element of theirs.
BREAKOUT_TAGS = BLOCK_TAGS | set("""b big br code em embed head i img listing meta nobr ruby s small span strong
    strike sub sup tt u var""".split())
CONTENT = ("article", "main", "content", "post", "entry", "story", "body-text")
CLUTTER = ("nav", "header", "footer", "aside", "form", "menu", "sidebar", "notice", "ad", "ads", "advert", "cookie",
           "banner", "comment", "comments", "related", "share", "promo", "newsletter", "breadcrumb", "popup",
           "subscribe", "widget", "sponsored", "consent", "reply", "login", "search", "button", "select", "label")
_CONTENT, _CLUTTER = frozenset(CONTENT), frozenset(CLUTTER)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S)
# The next end tag of a raw element; of all but scripts and styles, or the next start tag, which it cannot hold.
_RAW_END = {t: re.compile(rf"<(?P<end>/{'' if t in RAW_TAGS[:2] else '?'}){t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
_UNQUOTED = re.compile(r"=\s*[^\s\"'=]*/\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def _element(tag: str, attrs: str) -> tuple[str, ...]:
    """Tag and the words of its class, id and role."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower() if "=" in attrs else ""
    return (tag, *filter(None, _SPLIT.split(names)))


class Path:
    """The open elements down to a block: the last one, and the path above it, which blocks share.  Reads as the tuple of the elements."""

    __slots__ = ("above", "element", "tag", "content", "clutter", "_places")

    def __init__(self, above: Path | None, element: tuple[str, ...], tag: str):
        self.above, self.element, self.tag = above, element, tag
        self.content = above is not None and above.content or any(t in _CONTENT for t in element)
        self.clutter = above is not None and above.clutter or any(t in _CLUTTER for t in element)
        self._places = None

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        up, node = [], self
        while node is not None:
            up.append(node.element)
            node = node.above
        return reversed(up)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __getitem__(self, k):
        return tuple(self)[k]

    def __eq__(self, other) -> bool:
        return tuple(self) == tuple(other)

    __hash__ = None

    def places(self) -> frozenset:
        """Hashed places of all names on the path, at most ``PATH`` of them; paths that add none share them."""
        todo, node = [], self
        while node is not None and node._places is None:
            todo.append(node)
            node = node.above
        held = node._places if node is not None else frozenset()
        for node in reversed(todo):
            own = _places_of(node.element)
            held = held if own <= held else held | own
            node._places = held
        return held


_NO_PATH: tuple = ()
_element_places: dict[tuple[str, ...], frozenset] = {}


def _places_of(names: tuple[str, ...]) -> frozenset:
    found = _element_places.get(names)
    if found is None:
        if len(_element_places) > 50_000:
            _element_places.clear()
        found = _element_places[names] = frozenset(zlib.crc32(x.encode()) % PATH for x in names)
    return found


def _self_closed(attrs: str) -> bool:
    """Ends with a slash that is no part of an unquoted value."""
    return attrs.endswith("/") and not _UNQUOTED.search(attrs)


def _tokens(page: str) -> list[tuple[re.Match, str, int]]:
    """(tag or comment, small name, place behind it and the raw text it opens) in order."""
    out, at = [], 0
    while m := _TOKEN.search(page, at):
        tag, at = (m["tag"] or "").lower(), m.end()
        if tag in _RAW_END and not m["end"] and not _self_closed(m["attrs"]):
            stop = _RAW_END[tag].search(page, at)
            if stop and stop["end"]:
                at = stop.end()
            elif tag in RAW_TAGS[:2]:
                at = len(page)
        out.append((m, tag, at))
    return out


def _hidden(tokens: list[tuple[re.Match, str, int]]) -> dict[int, int]:
    """Start tag → end tag of every closed element of ``HIDDEN_TAGS``, as places in ``tokens``."""
    out, opened = {}, {t: [] for t in HIDDEN_TAGS}
    for k, (m, tag, _) in enumerate(tokens):
        if tag in HIDDEN_TAGS:
            if not m["end"]:
                if not _self_closed(m["attrs"]):
                    opened[tag].append(k)
            elif opened[tag]:
                out[opened[tag].pop()] = k
    return out


def blocks(page: str) -> list[tuple[Path | tuple, str, int]]:
    """(tag path, text, characters inside links) of every leaf block, in order;
    character references decoded, white space runs turned into one space."""
    out, parts, at, linked = [], [], 0, 0
    stack: list[Path] = []
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((stack[-1] if stack else _NO_PATH, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Closes the open elements from the ``k``-th on."""
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if open_tags["a"]:
                linked += len(text)
    tokens = _tokens(page)
    hidden, skip, foreign = _hidden(tokens), -1, []  # foreign: open drawings, formulas and HTML inside of them
    for k, (m, tag, behind) in enumerate(tokens):
        if k <= skip:
            at = behind
            continue
        if not foreign or foreign[-1] not in FOREIGN_TAGS:
            add(page[at:m.start()])
        at = behind
        if tag in HIDDEN_TAGS:
            skip = hidden.get(k, -1)
            continue
        if not tag or tag in _RAW_END or tag == "head" and not foreign:
            continue
        if tag in FOREIGN_TAGS or tag == "foreignobject" and foreign:
            if not m["end"]:
                if not m["attrs"].endswith("/"):
                    foreign.append(tag)
            elif tag in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(tag):]
            continue
        if foreign and foreign[-1] in FOREIGN_TAGS:
            if tag not in ("p", "br") and not open_tags[tag] if m["end"] else tag not in BREAKOUT_TAGS:
                continue
            while foreign and foreign[-1] in FOREIGN_TAGS:
                foreign.pop()
            if tag == "head":
                continue
        block = tag in BLOCK_TAGS
        if tag == "br":
            parts.append(" ")
        elif block:
            flush()
        if m["end"]:
            if tag in HEADINGS:  # ends any open heading
                tag = next((e.tag for e in reversed(stack) if e.tag in HEADINGS), tag) if any(open_tags[h] for h in HEADINGS) else tag
            if open_tags[tag]:
                k, inline = len(stack) - 1, True
                while stack[k].tag != tag:
                    inline = inline and stack[k].tag not in BLOCK_TAGS
                    if not (block or inline):
                        break
                    k -= 1
                else:
                    if block or inline and tag not in BLOCK_TAGS:
                        close(k)
        elif tag not in VOID_TAGS:
            if block and tag != "body":
                _close_implied(stack, open_tags, close, tag)
            stack.append(Path(stack[-1] if stack else None, _element(tag, m["attrs"]), tag))
            open_tags[tag] += 1
    if not foreign or foreign[-1] not in FOREIGN_TAGS:
        add(page[at:])
    flush()
    return out


# What an opening tag of the key ends if it is still open, up to the containers that shield it.
_ENDS = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
         "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}),
         "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SHIELDS = BLOCK_TAGS - HEADINGS - {"p"}
_ENDS_HEADING, _ENDS_OTHER = (HEADINGS | {"p"}, _SHIELDS), ({"p"}, _SHIELDS)


def _close_implied(stack: list[Path], open_tags: Counter[str], close, tag: str) -> None:
    ends, shields = _ENDS.get(tag, _ENDS_HEADING if tag in HEADINGS else _ENDS_OTHER)
    if not any(open_tags[t] for t in ends):
        return
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].tag in ends:
            close(k)
            if not any(open_tags[t] for t in ends if t != "p"):
                return
        elif stack[k].tag in shields:
            return


def _path_vector(path: Path | tuple) -> np.ndarray:
    """Places of the path's hashed names and of its last tag as a leaf."""
    if not path:
        return np.empty(0, np.int64)
    leaf = zlib.crc32(f"leaf {path.element[0]}".encode()) % PATH
    return np.fromiter(path.places() | {leaf}, np.int64)


def vectors(found: list[tuple[tuple, str, int]]) -> np.ndarray:
    """One vector per block: path tokens, word shares, lengths."""
    x = np.zeros((len(found), PATH + WORD + 3), np.float32)
    texts = [t.encode() for _, t, _ in found]
    sizes = np.array([len(t) for t in texts], np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    start, end, at = words(buf, offs)
    if len(start):
        bucket = (span_hash(prefix_hash(buf, BYTE_LOWER), start, end) % np.uint64(WORD)).astype(np.int64)
        row = np.repeat(np.arange(len(found)), np.diff(at))
        share = np.bincount(row * WORD + bucket, minlength=len(found) * WORD).reshape(-1, WORD)
        x[:, PATH:PATH + WORD] = share / np.maximum(np.diff(at), 1)[:, None]
    for i, (path, _, _) in enumerate(found):
        x[i, _path_vector(path)] = 1
    x[:, -3] = np.log1p(sizes) / 8
    x[:, -2] = np.log1p(np.diff(at)) / 6
    x[:, -1] = [n / max(1, len(t)) for _, t, n in found]
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        n, h = PATH + WORD + 3, HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = g.normal(0, 0.1, (n, 4 * h))
            self.p["h" + d] = g.normal(0, 0.1, (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["out"], self.p["bias"] = g.normal(0, 0.1, 2 * h), np.zeros(1)

    def _terms(self, x: np.ndarray, d: str) -> np.ndarray:
        """Input terms of all gates, as one product over all steps and pages."""
        return (x.reshape(-1, x.shape[2]) @ self.p["x" + d] + self.p["c" + d]).reshape(*x.shape[:2], -1)

    def terms(self, x: np.ndarray) -> np.ndarray:
        """Input terms of both directions' gates (blocks, 2 x gates) for the vectors of some blocks."""
        return (x @ np.concatenate([self.p["xf"], self.p["xb"]], axis=1)
                + np.concatenate([self.p["cf"], self.p["cb"]])).astype(np.float32)

    def terms_of(self, found: list[tuple]) -> np.ndarray:
        """``terms`` of any number of blocks; their vectors live a few at a time."""
        out = np.empty((len(found), 8 * HIDDEN), np.float32)
        for a in range(0, len(found), VECTORS_AT_ONCE):
            out[a:a + VECTORS_AT_ONCE] = self.terms(vectors(found[a:a + VECTORS_AT_ONCE]))
        return out

    def _outputs(self, z: np.ndarray, d: str) -> np.ndarray:
        """One direction's share in the logits (time, pages); nothing else of a step is kept."""
        h, w = HIDDEN, self.p["out"][:HIDDEN] if d == "f" else self.p["out"][HIDDEN:]
        hid, cell = np.zeros((z.shape[1], h)), np.zeros((z.shape[1], h))
        out = np.empty(z.shape[:2])
        for t in range(len(z)):
            a = z[t] + hid @ self.p["h" + d]
            gates = _sigmoid(a[:, :3 * h])
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * np.tanh(a[:, 3 * h:])
            hid = gates[:, 2 * h:] * np.tanh(cell)
            out[t] = hid @ w
        return out

    def _run(self, z: np.ndarray, d: str):
        """States of one direction; z: input terms (time, pages, gates)."""
        steps, pages, h = z.shape[0], z.shape[1], HIDDEN
        hid, cell, tape = np.zeros((pages, h)), np.zeros((pages, h)), []
        out = np.empty((steps, pages, h))
        for t in range(steps):
            a = z[t] + hid @ self.p["h" + d]
            gates, new = _sigmoid(a[:, :3 * h]), np.tanh(a[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            last_hid, last_cell = hid, cell
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            hid = o * squashed
            out[t] = hid
            tape.append((i, f, o, new, last_cell, squashed, last_hid))
        return out, tape

    def _back(self, grad: np.ndarray, tape: list, d: str):
        """Gradients of input terms and of the recurrent matrix."""
        h = HIDDEN
        gz, gh = np.empty((*grad.shape[:2], 4 * h)), np.zeros_like(self.p["h" + d])
        d_hid, d_cell = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, new, last_cell, squashed, last_hid = tape[t]
            d_hid = d_hid + grad[t]
            d_cell = d_cell + d_hid * o * (1 - squashed ** 2)
            gz[t] = np.concatenate([d_cell * new * i * (1 - i), d_cell * last_cell * f * (1 - f),
                                    d_hid * squashed * o * (1 - o), d_cell * i * (1 - new ** 2)], axis=1)
            gh += last_hid.T @ gz[t]
            d_hid, d_cell = gz[t] @ self.p["h" + d].T, d_cell * f
        return gz, gh

    @staticmethod
    def _flip(n: np.ndarray, steps: int) -> np.ndarray:
        """Time index that reverses each page's own blocks and leaves the padding."""
        t = np.arange(steps)[:, None]
        return np.where(t < n, n - 1 - t, t)

    def scores(self, pages: list[np.ndarray], keep_tape: bool = False):
        """Logits (time, pages) of pages padded to the longest."""
        n = np.array([len(p) for p in pages])
        steps, many = int(n.max()), len(pages)
        x = np.zeros((steps, many, PATH + WORD + 3))
        for k, p in enumerate(pages):
            x[:len(p), k] = p
        flip, cols = self._flip(n, steps), np.arange(many)
        back = x[flip, cols]
        out_f, tape_f = self._run(self._terms(x, "f"), "f")
        out_b, tape_b = self._run(self._terms(back, "b"), "b")
        both = np.concatenate([out_f, out_b[flip, cols]], axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        return (logits, (n, x, back, flip, cols, both, tape_f, tape_b)) if keep_tape else logits

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss per block."""
        logits, (n, x, back, flip, cols, both, tape_f, tape_b) = self.scores(pages, keep_tape=True)
        d = _sigmoid(logits)
        for k, y in enumerate(labels):
            d[:len(y), k] -= y
            d[len(y):, k] = 0
        d /= n.sum()
        g = {"out": d.ravel() @ both.reshape(-1, both.shape[2]), "bias": np.array([d.sum()])}
        spread = d[:, :, None] * self.p["out"]
        for name, seq, grad, tape in (("f", x, spread[:, :, :HIDDEN], tape_f),
                                      ("b", back, spread[:, :, HIDDEN:][flip, cols], tape_b)):
            gz, g["h" + name] = self._back(grad, tape, name)
            g["x" + name] = seq.reshape(-1, seq.shape[2]).T @ gz.reshape(-1, gz.shape[2])
            g["c" + name] = gz.sum(axis=(0, 1))
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> Labeller:
        """Adam over batches of pages of like length, in an order of its own each epoch."""
        g, step = np.random.default_rng(SEED), 0
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        var = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [order[a:a + BATCH] for a in range(0, len(order), BATCH)]
        for e in range(epochs):
            rate = RATE * (1 - 0.9 * e / epochs)
            for b in g.permutation(len(batches)):
                step += 1
                for k, v in self.gradients([pages[i] for i in batches[b]], [labels[i] for i in batches[b]]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    var[k] = 0.999 * var[k] + 0.001 * v * v
                    self.p[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def content(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are content, from the vectors of its blocks."""
        return self.decide([self.terms(p) for p in pages])

    def decide(self, terms: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are content, from its ``terms``."""
        out: list = [np.zeros(0, bool)] * len(terms)
        order = sorted((k for k in range(len(terms)) if len(terms[k])), key=lambda k: len(terms[k]))
        gates, a = 4 * HIDDEN, 0
        while a < len(order):
            # Pages of very different length run apart, so padding stays small.
            b = a + 1
            while b < len(order) and len(terms[order[b]]) <= min(2 * len(terms[order[a]]) + 8, STEPS_AT_ONCE // (b + 1 - a)):
                b += 1
            some, steps = order[a:b], len(terms[order[b - 1]])
            logits = np.zeros((steps, len(some)))
            for d, cut, way in (("f", slice(0, gates), 1), ("b", slice(gates, None), -1)):
                z = np.zeros((steps, len(some), gates), np.float32)
                for c, k in enumerate(some):
                    z[:len(terms[k]), c] = terms[k][::way, cut]
                got = self._outputs(z, d)
                for c, k in enumerate(some):
                    logits[:len(terms[k]), c] += got[:len(terms[k]), c][::way]
            for c, k in enumerate(some):
                out[k] = logits[:len(terms[k]), c] + self.p["bias"][0] > 0
            a = b
        return out


def labels_of(found: list[tuple[Path | tuple, str, int]]) -> np.ndarray:
    """Training labels: in a content container and in no clutter container."""
    return np.array([bool(p) and p.content and not p.clutter for p, _, _ in found], np.float32)


def _layout(g: np.random.Generator, paragraphs: list[str], others: list[str]) -> str:
    """A page of ``paragraphs`` as article, with clutter made of ``others``, under random names."""
    pick = lambda *x: x[int(g.integers(len(x)))]
    esc = html.escape
    some = lambda k: [esc(others[int(g.integers(len(others)))]) for _ in range(int(g.integers(1, k + 1)))]
    short = lambda t: " ".join(t.split()[:int(g.integers(1, 8))])

    def box(names, inner, tags=("div", "section")):
        name = pick(*names)
        tag = pick(*tags)
        return (f"<{name}>{inner}</{name}>" if name in BLOCK_TAGS and g.random() < 0.6
                else f'<{tag} {pick("class", "class", "id")}="{pick("", "site-", "main-")}{name}">{inner}</{tag}>')

    def links(k):
        return "<ul>" + "".join(f'<li><a href="/x">{short(t)}</a></li>' for t in some(k)) + "</ul>"

    def para(t):
        return f"<p>{t}</p>"
    clutter = [lambda: box(("ad", "advert", "ads", "sponsored", "promo"), pick(short, para)(some(1)[0])),
               lambda: box(("aside", "sidebar", "related", "widget"), links(6) + para(some(1)[0])),
               lambda: box(("notice", "cookie", "consent", "banner", "popup"), para(some(1)[0])),
               lambda: box(("form", "newsletter", "subscribe", "login", "search"),
                           f"<label>{short(some(1)[0])}</label><input name=q><button>{short(some(1)[0])}</button>"),
               lambda: box(("share", "breadcrumb", "menu"), links(4))]
    comments = lambda: box(("comments", "comment", "reply"), f"<h3>{short(some(1)[0])}</h3>" + "".join(
        f'<{t} class="comment">{para(x)}</{t}>' for t, x in ((pick("div", "li"), x) for x in some(5))))
    body = []
    for k, t in enumerate(paragraphs):
        body.append(pick(*(f"<h{i}>{esc(t)}</h{i}>" for i in (1, 2, 3))) if not k else pick(
            para, para, para, para, lambda x: f"<h2>{x}</h2>", lambda x: f"<ul><li>{x}</li><li>{x}</li></ul>",
            lambda x: f"<blockquote>{x}</blockquote>", lambda x: f"<div>{x}</div>",
            lambda x: f"<table><tr><td>{x}</td></tr></table>")(esc(t)))
        if g.random() < 0.1:
            body.append(pick(*clutter)())
    if g.random() < 0.2:
        body.append(comments())
    article = box(("article", "main", "content", "post", "entry", "story"), "".join(body))
    if g.random() < 0.3:
        article = f"<div class=wrap>{article}</div>"
    before = [box(("header", "nav", "menu"), links(8))] + [pick(*clutter)() for _ in range(int(g.integers(0, 3)))]
    after = ([comments()] if g.random() < 0.4 else []) + [pick(*clutter)() for _ in range(int(g.integers(0, 3)))]
    after.append(box(("footer",), pick(links(4), para(some(1)[0]), short(some(1)[0]))))
    return "<html><body>" + "".join(before) + article + "".join(after) + "</body></html>"


def train(pages: list[str], piece: int = PIECE_BLOCKS) -> Labeller:
    """A labeller for a sample of pages, learnt in pieces of at most ``piece`` blocks."""
    g = np.random.default_rng(SEED)
    parsed = [b for b in map(blocks, pages) if b]
    others = [t for b in parsed for _, t, _ in b if len(t) < 2000] or ["text"]
    train_on = list(parsed)
    for b in parsed:
        own = [t for (_, t, _), y in zip(b, labels_of(b), strict=True) if y] or others[:3]
        for _ in range(LAYOUTS):
            cut = own[:int(g.integers(1, len(own) + 1))]
            train_on.append(blocks(_layout(g, cut, others)))
    train_on = [b[a:a + piece] for b in train_on for a in range(0, len(b), piece)]
    if not train_on:
        return Labeller()
    return Labeller().fit([vectors(b) for b in train_on], [labels_of(b) for b in train_on])


def main_text(labeller: Labeller, found: list[list[tuple]]) -> list[str]:
    """Main texts of pages, given as their blocks."""
    ends = np.cumsum([len(f) for f in found])
    kept = labeller.decide(np.split(labeller.terms_of([b for f in found for b in f]), ends[:-1]))
    return [" ".join(t for (_, t, _), k in zip(f, keep, strict=True) if k) for f, keep in zip(found, kept, strict=True)]


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """Trains, in one task, on the ``sample`` different pages whose html has the smallest
    hashes (the same for the same table)."""
    ship_package(pages.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [h for b in batches for h in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(train(found).p)]})
    keyed = pages.filter("html IS NOT NULL").select("html", F.xxhash64("html").alias("_hash"))
    # Hashes first: copies meet as numbers, and only pages with a chosen hash move.
    least = keyed.select("_hash").distinct().orderBy("_hash").limit(sample)
    chosen = keyed.join(F.broadcast(least), "_hash", "left_semi").distinct().orderBy("_hash", "html").limit(sample).select("html")
    row = chosen.mapInArrow(run, "model binary").first()
    labeller = Labeller()
    if row:
        labeller.p = pickle.loads(bytes(row.model))
    return labeller


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``page_id``, ``url`` and main ``text`` of every row."""
    ship_package(pages.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, found, size = 0, [], 0
            for k, page in enumerate(b.column(2), 1):
                found.append(blocks(page.as_py() or ""))
                size += len(found[-1])
                if size >= BLOCKS_AT_ONCE or len(found) == PAGES_AT_ONCE or k == b.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(a, k - a), b.column(1).slice(a, k - a), pa.array(main_text(labeller, found), pa.string())],
                        names=["page_id", "url", "text"])
                    a, found, size = k, [], 0
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string")
