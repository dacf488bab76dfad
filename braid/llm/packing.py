"""Packing tokenised documents into sequences by best-fit decreasing.

``tokenise`` turns each text into token ids with a public tokenizer file and
cuts documents longer than a window into full windows and a rest.  ``pack``
deals the pieces into groups by a hash of their place, and in each group places them from the
longest to the shortest into the open sequence with the least room that still
fits; a segment tree indexed by the remaining room finds it.  A group has a few
thousand pieces, so the sequences it leaves partly filled are few against all.

Splitting a text at spaces and line feeds never changes its tokens (the
tokenizer drops white space and splits words there itself), so the ids of a
word are looked up in a bounded table and only new words are encoded.

Defined results.  Null text: empty, which is the end token alone.  Repeated
rows are packed as often as they occur.  Null ids are kept.  Clashing extra
columns are ignored by ``tokenise`` and carried by ``pack`` (it adds
``sequence_id`` and ``offset``, replacing columns of these names).  Empty
table: empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import blocks_for, kept, ship_package, tidy
from .textkernel import LOWER, prefix_hash, span_hash, words

CAPACITY = 4096
END_ID = 2
DOCS_PER_GROUP = 2048
# Entries of a worker's word tables (about 30 bytes each); a full table is emptied.
MOST_WORDS, RECENT_WORDS = 400_000, 30_000
ENCODE_AT_ONCE = 4096
CHUNK = 1 << 18
# Bytes that texts are split at, and ASCII marks but the apostrophe, which can belong to a word's token.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, 0x0A]] = True
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_encoders: dict[str, Encoder] = {}
kept["packing"] = _encoders.clear


class _IdTable:
    """Token ids by the 64-bit hash of a word, in sorted arrays: a large one and
    a small one of recent words.  Emptied when it holds too many words."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids = [np.empty(0, np.uint32)]
        self.used = 0
        self.tiers = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(2)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each key; -1 for unknown ones."""
        start, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, first, many in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                start[hit], size[hit] = first[at[hit]], many[at[hit]]
        return start, size

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New keys, each once, with their ids laid end to end."""
        new = (keys, self.used + np.cumsum(size) - size, size)
        self.ids.append(ids)
        self.used += len(ids)
        large, recent = self.tiers
        recent = self._merged(recent, new)
        if len(recent[0]) > RECENT_WORDS:
            large, recent = self._merged(large, recent), tuple(x[:0] for x in recent)
        self.tiers = [large, recent]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tiers)

    def gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        skip = np.repeat(start - (np.cumsum(size) - size), size)
        return self.ids[0][skip + np.arange(len(skip))]


class Encoder:
    """Token ids of texts, with tables of the words met so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = _IdTable(), _IdTable()

    @staticmethod
    def for_path(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _part_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``self.parts`` of strings the tokenizer treats on their own."""
        keys = np.fromiter(map(hash, parts), np.int64, len(parts)).view(np.uint64)
        start, size = self.parts.find(keys)
        lost = np.flatnonzero(start < 0)
        if len(lost):
            _, first = np.unique(keys[lost], return_index=True)
            lost = lost[first]
            for a in range(0, len(lost), ENCODE_AT_ONCE):
                some = lost[a:a + ENCODE_AT_ONCE]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast([parts[k] for k in some], add_special_tokens=False)]
                self.parts.add(keys[some], np.array([i for x in ids for i in x], np.uint32),
                               np.array([len(x) for x in ids], np.int64))
            start, size = self.parts.find(keys)
        return start, size

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Ids of new words: a word of letters and its trailing marks one by one, as the tokenizer splits them."""
        parts = []
        for w in words:
            core = w.rstrip(MARKS)
            parts += (core, w[len(core):]) if core.isalpha() else (w, "")
        start, size = self._part_ids(parts)
        self.words.add(keys, self.parts.gather(start, size), size.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        for table in (self.words, self.parts):
            if len(table) > MOST_WORDS:
                table.clear()
        buf = np.frombuffer(b"".join(texts), np.uint8)
        # The tokenizer lower-cases after joining letters with accents, so only texts without such accents go first.
        if not np.isin(buf, (0xCC, 0xCD)).any():
            buf = LOWER[buf]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start, end, at = words(buf, offs, BREAKS)
        keys, first, inverse = np.unique(span_hash(prefix_hash(buf), start, end), return_index=True, return_inverse=True)
        place, size = self.words.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = buf.tobytes()
            self._learn(keys[new], [raw[start[k]:end[k]].decode() for k in first[new]])
            place, size = self.words.find(keys)
        counts = np.concatenate([[0], np.cumsum(size[inverse])])[at]
        return self.words.gather(place[inverse], size[inverse]), np.diff(counts)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``start``,
    ``length``, ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit
    numbers).  A document's ids are its text's and ``end_id``; all its pieces
    but the last fill a window of ``capacity``."""
    ship_package(docs.sparkSession)

    def pieces(encoder: Encoder, doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
        ids, counts = encoder.encode(texts)
        at, out = 0, [[], [], [], [], []]
        for i, n in zip(doc_ids, counts, strict=True):
            own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
            at += n
            for s in range(0, len(own), capacity):
                part = own[s:s + capacity]
                for o, v in zip(out, (i, s, len(part), len(own), part.tobytes()), strict=True):
                    o.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(o, t) for o, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)],
            names=["doc_id", "start", "length", "doc_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.for_path(path or default_path())  # where the task runs
        for b in batches:
            doc_ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                doc_ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size > CHUNK:
                    yield pieces(encoder, doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield pieces(encoder, doc_ids, texts)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run, "packing"), "doc_id long, start long, length long, doc_tokens long, ids binary")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; no length exceeds ``capacity``."""
    leaves = 1
    while leaves <= capacity:
        leaves *= 2
    tree = [0] * (2 * leaves)  # open sequences below each node; leaf r: those with room r
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0

    def add(room: int, by: int) -> None:
        node = room + leaves
        while node:
            tree[node] += by
            node >>= 1

    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        node = need + leaves
        if not tree[node]:  # up to the first right neighbour with an open sequence, then down its left side
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node *= 2
                    if not tree[node]:
                        node += 1
        if node > 1:
            room = node - leaves
            s = with_room[room].pop()
            add(room, -1)
        else:
            s, room, used = used, capacity, used + 1
        sequence[k], offset[k] = s, capacity - room
        if room > need:
            with_room[room - need].append(s)
            add(room - need, 1)
    return sequence, offset


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` (unique over all groups) and ``offset`` (gapless
    from 0 in each sequence).  ``pieces``: ``doc_id``, ``start``, ``length`` and any columns to
    carry; ``documents``: about how many documents they come from."""
    ship_package(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    groups = blocks_for(documents, DOCS_PER_GROUP)
    # By the row, not by its values: equal or null ids spread over all groups.
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    names = pieces.columns
    key = "_group"
    while key in names:
        key += "_"

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(rows["length"].to_numpy(np.int64), capacity)
        return rows[names].assign(sequence_id=(int(rows[key].iloc[0]) << 32) + sequence, offset=offset)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return pieces.withColumn(key, group).groupBy(key).applyInPandas(place, schema)
