"""How far sources diverge in their use of terms: an exact recount through perfect hashes.

1. ``kept_terms``: the exact number of a language's documents that hold each term; those in
   ``LEAST_DOCS`` or more are kept.
2. ``perfect_hashes``: a language's kept terms are dealt by their hash into parts of about
   ``PART_BYTES``; a part gets a minimal perfect hash (levels of bit arrays,
   a key's slot being the rank of the first bit it has for itself) and its keys in slot order.
3. ``recount``: the parts are broadcast, ``SLICE_BYTES`` at a time (a larger vocabulary is counted in
   several passes).  A task looks the distinct terms of a few texts up, compares the
   key stored in the slot byte by byte, and adds to dense slots of its (language, source) groups; the tasks' slots are
   sent packed, a row per group and part, and added up.
4. ``divergence``: smoothed shares of the groups, compared part by part in blocks of sources: every
   two sources of a language, and each source with its language term by term.

64-bit hashes only find places: occurrences are compared with a first one of their hash, and that one with the
stored key, so equal hashes of different terms change nothing.  All figures are integers.

Defined results.  Null language, source and text are empty strings.  Texts without terms make a group all the same.  A
language without kept terms has pairs of value 0 and no terms.  Ties go to the item that is smaller as UTF-8
bytes.  Repeated rows are documents of their own.  Empty table: empty result.  Other columns are ignored.  Long texts are cut
between words; a single word is held whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, small_batches, small_side, stored, tidy
from .textkernel import BYTE_LOWER, LOWER, PLACE, mix64, prefix_hash, span_hash, words

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
CHUNK = 1 << 20
PART_BYTES, SLICE_BYTES = 64 << 10, 32 << 20
# Besides its bytes a stored key costs its length and its share of the bit arrays.
KEY_COST = 16
LEVELS, ROOM = 32, 2
# Dense counters of a task (eight bytes each).
MOST_CELLS = 4 << 20
# Sources in a block; two blocks are compared in a task.
BLOCK_SOURCES = 128

# Terms are letters of ASCII and everything beyond ASCII; all other bytes part them.
BREAKS = np.ones(256, bool)
BREAKS[0x41:0x5B] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False

Hash = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def term_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span, capitals of ASCII as small letters."""
    return span_hash(prefix_hash(buf, BYTE_LOWER), start, end)


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the spans, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def same(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray,
         b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether spans of ``a`` and ``b`` hold the same bytes, pair by pair."""
    out = a_size == b_size
    k = np.flatnonzero(out & (a_size > 0))
    if len(k):
        equal = a[flat(a_start[k], a_size[k])] == b[flat(b_start[k], b_size[k])]
        out[k] = np.logical_and.reduceat(equal, np.cumsum(a_size[k]) - a_size[k])
    return out


class Terms:
    """The terms of some texts: ``low`` (all bytes, lower-cased), ``start`` and ``size`` of every
    occurrence, ``text`` it lies in, ``of`` the number of its distinct term, ``first`` an occurrence of each
    distinct term and ``hash`` its hash."""

    def __init__(self, texts: list[bytes], hashing: Hash = term_hash):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.start, end, at = words(buf, offs, BREAKS)
        self.size = end - self.start
        self.low = LOWER[buf]
        self.text = np.repeat(np.arange(len(texts)), np.diff(at))
        h = hashing(buf, self.start, end)
        self.hash, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        rep = first[self.of]
        wrong = np.flatnonzero(~same(self.low, self.start, self.size, self.low, self.start[rep], self.size[rep]))
        more: dict[bytes, int] = {}  # terms that share the hash of another one
        for k in wrong:
            term = self.low[self.start[k]:self.start[k] + self.size[k]].tobytes()
            if term not in more:
                more[term] = len(first)
                first, self.hash = np.append(first, k), np.append(self.hash, h[k])
            self.of[k] = more[term]
        self.first = first

    def strings(self, which: np.ndarray) -> pa.Array:
        """The distinct terms numbered ``which``."""
        start, size = self.start[self.first[which]], self.size[self.first[which]]
        offs = np.concatenate([[0], np.cumsum(size)])
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offs.astype(np.int64).tobytes()),
                                                pa.py_buffer(self.low[flat(start, size)].tobytes())).cast(pa.string())


def cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes, cut where no term is."""
    apart, a = BREAKS[np.frombuffer(text, np.uint8)], 0
    while a < len(text):
        b = a + limit
        if b < len(text):
            back = np.flatnonzero(apart[a:b])
            on = np.argmax(apart[b:]) if not len(back) else 0
            b = a + back[-1] + 1 if len(back) else b + on if apart[b + on] else len(text)
        yield text[a:b]
        a = b


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes], bool]]:
    """(labels, texts, whole): rows of a few texts each, their label being the columns before the last, the text;
    a longer text comes in pieces of its own, not ``whole``, the last one with an empty list after it."""
    for b in batches:
        labels, texts, size = [], [], 0
        columns = [c.to_pylist() for c in b.columns[:-1]]
        for *label, t in zip(*columns, b.columns[-1].cast(pa.binary()), strict=True):
            t = t.as_py() or b""
            if len(t) > limit:
                for piece in cut(t, limit):
                    yield [tuple(label)], [piece], False
                yield [tuple(label)], [], False
                continue
            labels.append(tuple(label))
            texts.append(t)
            size += len(t)
            if size > limit:
                yield labels, texts, True
                labels, texts, size = [], [], 0
        if texts:
            yield labels, texts, True


def numbered(labels: list) -> tuple[list, np.ndarray]:
    """Distinct labels and the number of each row's."""
    of = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    return list(of), np.array([of[x] for x in labels], np.int64)


def counted(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code // base, code % base, how often) of all distinct codes."""
    code, n = np.unique(codes, return_counts=True)
    return code // max(1, base), code % max(1, base), n


def read(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, limit: int = CHUNK, hashing: Hash = term_hash) -> DataFrame:
    """Stored ``lang``, ``term`` of the terms in ``least`` or more documents of the language."""
    def rows(lang: list[str], term: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), term, pa.array(n, pa.int64())], names=["lang", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_long: set[bytes] = set()
        for labels, texts, whole in chunks(batches, limit):
            if not texts:  # a long text has ended
                some = sorted(of_long)
                for a in range(0, len(some), 1 << 16):
                    part = some[a:a + (1 << 16)]
                    yield rows([labels[0][0]] * len(part), pa.array([t.decode(errors="replace") for t in part], pa.string()), np.ones(len(part)))
                of_long = set()
                continue
            t = Terms(texts, hashing)
            if not whole:
                at, size = t.start[t.first], t.size[t.first]
                of_long |= {t.low[a:a + s].tobytes() for a, s in zip(at, size, strict=True)}
                continue
            langs, lang = numbered([x[0] for x in labels])
            many = len(t.first)
            text, term, _ = counted(t.text * many + t.of, many)
            lang, term, n = counted(lang[text] * many + term, many)
            yield rows([langs[k] for k in lang], t.strings(term), n)
    found = read(docs).select("lang", "text").mapInArrow(tidy(run), "lang string, term string, n long")
    return stored(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"))


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: slots 0 to n - 1.  Every level is a bit array in which a key
    that is alone at its place sets a bit; the others go to the next level.  Keys that never part (equal ones) have the
    last slots and are found by the key itself."""

    def __init__(self, keys: np.ndarray):
        self.slot, left, self.n = np.full(len(keys), -1), np.arange(len(keys)), 0
        self.levels: list[tuple[int, bytes]] = []
        for level in range(LEVELS):
            if not len(left):
                break
            room = max(64, ROOM * len(left))
            place = self._place(keys[left], level, room)
            alone = np.bincount(place, minlength=room) == 1
            mine = alone[place]
            self.slot[left[mine]] = self.n + np.cumsum(alone)[place[mine]] - 1
            self.levels.append((room, np.packbits(alone).tobytes()))
            self.n += int(alone.sum())
            left = left[~mine]
        left = left[np.argsort(keys[left], kind="stable")]
        self.slot[left], self.rest = self.n + np.arange(len(left)), keys[left]
        self.placed, self.n = self.n, len(keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, room: int) -> np.ndarray:
        return (mix64(keys + PLACE[level]) % np.uint64(room)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, candidates): the only slot each key can have, or the first of some candidates; 0 candidates: none."""
        slot, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        left, base = np.arange(len(keys)), 0
        for level, (room, packed) in enumerate(self.levels):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=room)
            rank = np.cumsum(bits)
            place = self._place(keys[left], level, room)
            hit = bits[place] == 1
            slot[left[hit]], many[left[hit]] = base + rank[place[hit]] - 1, 1
            base += int(rank[-1])
            left = left[~hit]
        lo, hi = (np.searchsorted(self.rest, keys[left], side) for side in ("left", "right"))
        slot[left], many[left] = self.placed + lo, hi - lo
        return slot, many


class Part:
    """A part of a language's vocabulary: the perfect hash and the keys, end to end, in slot order."""

    def __init__(self, terms: list[bytes], hashing: Hash = term_hash):
        buf, size = np.frombuffer(b"".join(terms), np.uint8), np.array([len(t) for t in terms], np.int64)
        start = np.cumsum(size) - size
        self.index = PerfectHash(hashing(buf, start, start + size))
        order = np.argsort(self.index.slot)
        self.size, self.keys = size[order], buf[flat(start[order], size[order])]
        self.start = np.cumsum(self.size) - self.size
        del self.index.slot

    def strings(self) -> list[str]:
        raw = self.keys.tobytes()
        return [raw[a:a + n].decode(errors="replace") for a, n in zip(self.start, self.size, strict=True)]

    def slots(self, t: Terms, which: np.ndarray) -> np.ndarray:
        """Slot of the distinct terms numbered ``which``; -1 for those whose bytes are not the stored key's."""
        slot, many = self.index.find(t.hash[which])
        at, size = t.start[t.first[which]], t.size[t.first[which]]
        known = np.flatnonzero(many)
        s = slot[known]
        good = same(t.low, at[known], size[known], self.keys, self.start[s], self.size[s])
        out = np.full(len(which), -1)
        out[known[good]] = s[good]
        for k in known[~good & (many[known] > 1)]:  # further keys of the same hash
            term = t.low[at[k]:at[k] + size[k]].tobytes()
            for j in range(slot[k] + 1, slot[k] + many[k]):
                if self.keys[self.start[j]:self.start[j] + self.size[j]].tobytes() == term:
                    out[k] = j
        return out


def part_of(h: np.ndarray, parts) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.asarray(parts).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def perfect_hashes(kept: DataFrame, part_bytes: int = PART_BYTES, hashing: Hash = term_hash) -> DataFrame:
    """Stored rows ``lang``, ``part``, ``parts`` (of the language), ``size`` (bytes) and ``state`` (a pickled ``Part``)."""
    cost = F.sum(F.octet_length("term") + F.lit(KEY_COST))
    langs = stored(kept.groupBy("lang").agg(F.ceil(cost / F.lit(part_bytes)).alias("parts")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = b.column("term").cast(pa.binary()).to_pylist()
            size = np.array([len(t) for t in terms], np.int64)
            end = np.cumsum(size)
            h = hashing(np.frombuffer(b"".join(terms), np.uint8), end - size, end)
            part = part_of(h, b.column("parts").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=["lang", "term", "parts", "part"])

    def hashed(rows: pd.DataFrame) -> pd.DataFrame:
        state = pickle.dumps(Part(sorted(t.encode() for t in rows["term"]), hashing))
        return pd.DataFrame([(rows["lang"].iloc[0], rows["part"].iloc[0], rows["parts"].iloc[0], len(state), state)],
                            columns=["lang", "part", "parts", "size", "state"])
    dealt = kept.join(small_side(langs), "lang").select("lang", "term", "parts").mapInArrow(
        tidy(deal), "lang string, term string, parts long, part long")
    return stored(dealt.groupBy("lang", "part").applyInPandas(hashed, "lang string, part long, parts long, size long, state binary"))


COUNTS = "lang string, source string, part long, total long, slots binary, counts binary"


def packed(slot: np.ndarray, n: np.ndarray) -> tuple[int, bytes, bytes]:
    """(sum, slots, counts) of sorted slots; what ``unpacked`` reads."""
    return int(n.sum()), compress(slot.astype("<u4").tobytes()), compress(n.astype("<i8").tobytes())


def unpacked(slots: bytes, counts: bytes, size: int | None = None) -> np.ndarray:
    """Dense counts of ``size`` slots, or of as many as it takes."""
    slot, n = (np.frombuffer(zstandard.decompress(x), kind) for x, kind in ((slots, "<u4"), (counts, "<i8")))
    out = np.zeros(int(slot[-1]) + 1 if size is None else size, np.int64)
    out[slot] = n
    return out


def compress(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


class Counters:
    """Dense slots of the groups a task has met, for the parts of one slice."""

    def __init__(self, slice_rows: list, most: int = MOST_CELLS):
        self.parts: dict[str, dict[int, tuple[int, Part]]] = {}
        self.total: dict[str, int] = {}
        self.of: dict[str, int] = {}
        for lang, part, parts, state in slice_rows:
            loaded, before = pickle.loads(state), self.total.get(lang, 0)
            self.parts.setdefault(lang, {})[part] = (before, loaded)
            self.total[lang], self.of[lang] = before + loaded.index.n, parts
        self.dense: dict[tuple, np.ndarray] = {}
        self.cells, self.most = 0, most

    def add(self, groups: list, group: np.ndarray, t: Terms) -> Iterator[pa.RecordBatch]:
        """Adds the terms of some texts; ``group``: the number of each text's label in ``groups``.  Groups that
        find no room for slots of their own any more are sent on at once."""
        many = len(t.first)
        g, term, n = counted(group[t.text] * many + t.of, many)
        place = {}
        for lang in {x[0] for x in groups} & self.parts.keys():
            mine = np.unique(term[np.isin(g, [k for k, x in enumerate(groups) if x[0] == lang])])
            slots, part = np.full(many, -1), part_of(t.hash[mine], self.of[lang])
            for p in np.unique(part):
                if p in self.parts[lang]:
                    before, held = self.parts[lang][p]
                    some = mine[part == p]
                    s = held.slots(t, some)
                    slots[some] = np.where(s >= 0, before + s, -1)
            place[lang] = slots
        edge = np.searchsorted(g, np.arange(len(groups) + 1))
        for k, label in enumerate(groups):
            if label[0] not in place:
                continue
            s, c = place[label[0]][term[edge[k]:edge[k + 1]]], n[edge[k]:edge[k + 1]]
            s, c = s[s >= 0], c[s >= 0]
            if label not in self.dense and self.cells + self.total[label[0]] <= self.most:
                self.dense[label] = np.zeros(self.total[label[0]], np.int64)
                self.cells += len(self.dense[label])
            if label in self.dense:
                self.dense[label][s] += c
            else:
                order = np.argsort(s)
                yield from self._rows(label, s[order], c[order])

    def _rows(self, label: tuple, slot: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        lang, out = label[0], []
        for part, (before, held) in self.parts[lang].items():
            a, b = np.searchsorted(slot, [before, before + held.index.n])
            if b > a:
                out.append((*label, int(part), *packed(slot[a:b] - before, n[a:b])))
        if out:
            yield counts_batch(out)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All counts above 0 of the dense slots."""
        for label, dense in self.dense.items():
            slot = np.flatnonzero(dense)
            yield from self._rows(label, slot, dense[slot])


def counts_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["lang", "source", "part", "total", "slots", "counts"])


def added_up(rows: DataFrame) -> DataFrame:
    """One row per (lang, source, part), the counts of all its rows added.  Rows come sorted, so a task holds one part's slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dense = None, np.zeros(0, np.int64)

        def row():
            slot = np.flatnonzero(dense)
            return counts_batch([(*key, *packed(slot, dense[slot]))])
        for b in batches:
            for *label, _, slots, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                more = unpacked(slots, counts)
                if label != key:
                    if key is not None:
                        yield row()
                    key, dense = label, more
                    continue
                if len(more) > len(dense):
                    dense, more = more, dense
                dense[:len(more)] += more
        if key is not None:
            yield row()
    keys = ["lang", "source", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), COUNTS)


def recount(docs: DataFrame, parts: DataFrame, slice_bytes: int = SLICE_BYTES, limit: int = CHUNK,
            most: int = MOST_CELLS, hashing: Hash = term_hash) -> DataFrame:
    """Stored ``lang``, ``source``, ``part``, ``slot``, ``n``: how often each kept term occurs in each group that has it."""
    spark = docs.sparkSession
    order = Window.orderBy("lang", "part")  # one row per MB of vocabulary
    sliced = stored(parts.select("lang", "part", "size").withColumn(
        "slice", F.floor((F.sum("size").over(order) - F.col("size")) / F.lit(slice_bytes))))
    out = None
    for number in [r.slice for r in sliced.select("slice").distinct().orderBy("slice").collect()]:
        rows = parts.join(sliced.filter(F.col("slice") == number).select("lang", "part"), ["lang", "part"])
        held = spark.sparkContext.broadcast([(r.lang, r.part, r.parts, bytes(r.state)) for r in rows.orderBy("lang", "part").collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            counters = Counters(held.value, most)
            for labels, texts, _ in chunks(batches, limit):
                groups, group = numbered(labels)
                if texts:
                    yield from counters.add(groups, group, Terms(texts, hashing))
            yield from counters.rows()
        counts = stored(added_up(read(docs).mapInArrow(tidy(run), COUNTS)))
        held.unpersist()
        out = counts if out is None else out.unionByName(counts)
    return spark.createDataFrame([], COUNTS) if out is None else out


def share(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly: three digits at a time, as SCALE has nine."""
    whole = total + 2 * terms
    out, rest = np.divmod(n + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


FOUND = "lang string, kind string, a long, b long, item string, value long"


def compared(sources: pd.DataFrame, sides: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of one part of a language: for every two sources of two blocks the sum of their gaps, and for the sources of a block
    met with itself the ``top`` terms used more than by the language.  ``sources``: a row each; ``sides``: one row."""
    side, out = sides.iloc[0], []
    held: Part = pickle.loads(side["state"])
    sources = sources.sort_values("source_no")
    number, block = sources["source_no"].to_numpy(), sources["block"].to_numpy()
    counts = [unpacked(r.slots, r.counts, held.index.n) if r.slots is not None else np.zeros(held.index.n, np.int64)
              for r in sources.itertuples(index=False)]
    p = np.array([share(n, int(t), int(side["terms"])) for n, t in zip(counts, sources["group_total"], strict=True)])
    for k in np.flatnonzero(block == side["lo"]):
        others = np.flatnonzero((block == side["hi"]) & (number > number[k]))
        if len(others):
            out.append(pd.DataFrame({"kind": "pair", "a": number[k], "b": number[others], "item": "",
                                     "value": gap(p[others], p[k]).sum(axis=1)}))
    if side["lo"] == side["hi"]:
        whole = unpacked(side["all_slots"], side["all_counts"], held.index.n)
        q, terms = share(whole, int(side["lang_total"]), int(side["terms"])), held.strings()
        for k in range(len(number)):
            used = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = gap(p[k][used], q[used])
            if len(used) > top:  # all that are not below the last of the first ones
                some = value >= np.partition(value, -top)[-top]
                used, value = used[some], value[some]
            best = sorted(zip(-value, (terms[s].encode() for s in used), strict=True))[:top]
            if best:
                out.append(pd.DataFrame({"kind": "term", "a": number[k], "b": -1, "item": [t.decode() for _, t in best],
                                         "value": [-int(v) for v, _ in best]}))
    columns = ["lang", "kind", "a", "b", "item", "value"]
    return pd.concat(out).assign(lang=side["lang"])[columns] if out else pd.DataFrame(columns=columns)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, limit: int = CHUNK, part_bytes: int = PART_BYTES,
               slice_bytes: int = SLICE_BYTES, most: int = MOST_CELLS, block_sources: int = BLOCK_SOURCES,
               hashing: Hash = term_hash) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank``: for every
    (language, source) of ``docs`` all other sources of the language by the sum of the gaps between their shares,
    and the ``top`` terms it uses more than its language does."""
    kept = kept_terms(docs, least, limit, hashing)
    parts = perfect_hashes(kept, part_bytes, hashing)
    counts = recount(docs, parts, slice_bytes, limit, most, hashing)

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("group_total"))
    lang = Window.partitionBy("lang")
    groups = stored(
        read(docs).select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
        .fillna(0, ["terms", "group_total"])
        .withColumn("lang_total", F.sum("group_total").over(lang))
        .withColumn("source_no", F.row_number().over(lang.orderBy("source")).cast("long") - 1)
        .withColumn("blocks", F.ceil(F.count(F.lit(1)).over(lang) / F.lit(block_sources)))
        .withColumn("block", F.floor(F.col("source_no") / F.lit(block_sources))))

    # Every part of a language meets every two blocks of its sources.
    meets = lambda a, b: (F.explode(F.sequence(F.col(a), F.col(b))))
    langs = groups.groupBy("lang").agg(*[F.first(c).alias(c) for c in ("terms", "lang_total", "blocks")])
    whole = added_up(counts.withColumn("source", F.lit(""))).select(
        "lang", "part", F.col("slots").alias("all_slots"), F.col("counts").alias("all_counts"))
    sides = (parts.join(small_side(langs), "lang").join(whole, ["lang", "part"])
             .withColumn("_last", F.col("blocks") - 1).withColumn("_zero", F.lit(0).cast("long"))
             .withColumn("lo", meets("_zero", "_last")).withColumn("hi", meets("lo", "_last"))
             .select(*[F.col(c).alias(c) for c in ("lang", "part", "lo", "hi", "terms", "lang_total", "state", "all_slots", "all_counts")]))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_other")
    rows = (parts.select("lang", "part").join(small_side(groups), "lang").join(counts.drop("total"), ["lang", "part", "source"], "left")
            .select("lang", "part", "source_no", "block", "group_total", "slots", "counts", other)
            .withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other"))
    key = ["lang", "part", "lo", "hi"]
    found = stored(rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(lambda a, b: compared(a, b, top), FOUND))

    sums = found.filter("kind = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without kept terms have no parts.
    no_terms = groups.filter("terms = 0").select("lang", F.col("source_no").alias("a"))
    zero = no_terms.join(no_terms.withColumnRenamed("a", "b"), "lang").filter("a < b").withColumn("value", F.lit(0).cast("long"))
    both = sums.unionByName(zero).select(
        "lang", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                  F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "value")
    name = lambda no, as_: small_side(groups.select("lang", F.col("source_no").alias(no), F.col("source").alias(as_)))
    pair = (both.select("lang", F.col("e.x").alias("x"), F.col("e.y").alias("y"), "value")
            .join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]))
    term = found.filter("kind = 'term'").withColumnRenamed("a", "x").join(name("x", "source"), ["lang", "x"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return ranked(pair, "pair").unionByName(ranked(term, "term").filter(F.col("rank") <= top))
