"""Secret scans: candidate strings judged by a random forest.

A candidate is a run of letters, digits and ``_ + / -`` with a digit and at
least ``LEAST`` characters, or of ``LONG`` characters with or without a digit;
any value assigned to a name of ``NAMES``, of any length, to its closing quote on the
line or, if there is none, to white space (less closing punctuation); and any string of a known shape (``SHAPES``).
What overlaps is one candidate.  The forest (MLlib) removes the false positives among them.  Its features are

* the candidate's length, its character classes and how often neighbouring
  characters change class, its distinct characters and entropy;
* dictionary coverage: the share of its characters inside common short words of
  the corpus (counted over all texts, see ``dictionary``);
* its path: hashed parts of the document's source;
* hashed neighbouring words, two before and one after, and the marks between.

It is trained on labelled findings: a candidate is labelled a secret if the text
assigns it to a name of ``NAMES`` or it has a known shape, else a false positive.
A labelled secret is one for sure, as its form tells it; the forest judges the others,
and so finds what stands alone or behind other names.  At most about ``SAMPLE``
different findings (text, place and value), half of each kind if there are so many, chosen by
a hash, are learnt from; every candidate of every text is judged, whole texts are scanned.

Defined results.  Null or empty text: no candidates.  Null source: a path of
its own.  Without labelled findings of both kinds there is no forest, and the
labels stand.  Equal texts of equal source have equal findings; repeated rows repeat them.
Empty table: empty result.  Extra columns are ignored by ``scan`` and kept by
``redact``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, ship_package, small_side, stored, tidy

LEAST, LONG = 8, 24
SAMPLE = 8000
TREES, DEPTH, SEED = 30, 8, 3
DICTIONARY_WORDS = 2000
WORD_BUCKETS, PATH_BUCKETS = 16, 8
BROADCAST_ROWS = 100_000
CHUNK = 1 << 20
MASK = "<secret>"

# Names that secrets are assigned to.
NAMES = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key", "auth", "bearer",
         "credential", "private_key")
_NAMED = re.compile(rb"(?:" + "|".join(NAMES).encode() + rb")[\"']?\s{0,3}$", re.I)
_GAP = re.compile(rb"[:=]{1,3}>?\s{0,3}")
# A value to the closing quote on its line (a backslash takes the next character along), or to white space.
_VALUE = re.compile(rb"\"((?:[^\"\\\r\n]|\\.)+)\"|'((?:[^'\\\r\n]|\\.)+)'|[\"']?([^\s\"']\S*)")
_CLOSING = b".,;:)]}>\"'`"
# Known shapes, each with the literal strings it begins with; the group is the secret.
SHAPES = [
    ((b"AKIA", b"ASIA"), rb"((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ((b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), rb"(gh[pousr]_[A-Za-z0-9]{16,})"),
    ((b"github_pat_",), rb"(github_pat_[A-Za-z0-9_]{16,})"),
    ((b"eyJ",), rb"(eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_=-]+){0,4})"),
    ((b"Bearer", b"bearer", b"BEARER"),
     rb"(?:Bearer|bearer|BEARER)[ \t]+((?=[A-Za-z._~+/=-]*[0-9])[A-Za-z0-9._~+/=-]{8,}|[A-Za-z0-9._~+/=-]{20,})"),
    ((b"-----BEGIN ",), rb"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----).)*-----END [A-Z0-9 ]*PRIVATE KEY"
                        rb"(?: BLOCK)?-----|(?:\s+[A-Za-z0-9+/=]{16,})*))"),
]
SHAPES = [(first, re.compile(shape, re.S)) for first, shape in SHAPES]
_WORD = re.compile(rb"[^\s\"'=:,;()<>]+")

RUN = np.zeros(256, bool)
RUN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/-"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
# Character classes: other, small letter, capital, digit.
CLASS = np.zeros(256, np.uint8)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A] = 1, 2, 3
_LETTER_VALUE = np.zeros(256, np.int64)
_LETTER_VALUE[0x61:0x7B] = _LETTER_VALUE[0x41:0x5B] = np.arange(1, 27)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last row, bytes, offsets) of runs of about ``CHUNK`` bytes of texts."""
    texts, a, size = [], 0, 0
    for k, t in enumerate(batch.column(column).cast(pa.binary())):
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size > CHUNK or k + 1 == batch.num_rows:
            offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            yield a, k + 1, np.frombuffer(b"".join(texts), np.uint8), offs
            texts, a, size = [], k + 1, 0


def _runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of set places, none across two texts."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _told(raw: bytes, marks: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the values assigned to secrets' names and of strings of known shapes;
    ``marks``: the places of ``:`` and ``=``."""
    out = []
    for k, r in zip(marks.tolist(), (np.searchsorted(offs, marks, "right") - 1).tolist(), strict=True):
        lo, hi = int(offs[r]), int(offs[r + 1])
        if not _NAMED.search(raw[max(lo, k - 24):k]):
            continue
        if m := _VALUE.match(raw, _GAP.match(raw, k, hi).end(), hi):
            start, end = m.span(m.lastindex)
            if m.lastindex == 3:
                end = start + (len(m[3].rstrip(_CLOSING)) or len(m[3]))
            out.append((start, end))
    for first, shape in SHAPES:
        for literal in first:
            at = raw.find(literal)
            while at >= 0:
                r = np.searchsorted(offs, at, "right")
                lo, hi = int(offs[r - 1]), int(offs[r])
                m = None if at > lo and raw[at - 1:at].isalnum() else shape.match(raw, at, hi)
                if m:
                    out.append((m.start(1), m.start(1) + len(m[1].rstrip(_CLOSING))))
                at = raw.find(literal, m.end() if m else at + 1)
    return out


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three or four ASCII letters, small and capital alike, over all texts
    (``words`` of them; ties to the smaller word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 ** 4, np.int64)
        for b in batches:
            for _, _, buf, offs in _chunks(b, 0):
                start, end = _runs((CLASS[buf] == 1) | (CLASS[buf] == 2), offs)
                start, size = start[(end - start >= 3) & (end - start <= 4)], (end - start)
                size = size[(size >= 3) & (size <= 4)]
                value = _LETTER_VALUE[buf]
                code = np.zeros(len(start), np.int64)
                for j in range(4):
                    code = code * 27 + np.where(j < size, value[np.minimum(start + j, len(buf) - 1)], 0)
                total += np.bincount(code, minlength=27 ** 4)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": some, "n": total[some]})
    counts = docs.select("text").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    best = counts.orderBy(F.col("n").desc(), "code").limit(words).collect()

    def word(code: int) -> str:
        letters = [code // 27 ** k % 27 for k in (3, 2, 1, 0)]
        return "".join(chr(0x60 + x) for x in letters if x)
    return [word(r.code) for r in best]


def _covered(value: str, known: set[str]) -> float:
    low, cover = value.lower(), bytearray(len(value))
    for size in (3, 4):
        for k in range(len(low) - size + 1):
            if low[k:k + size] in known:
                cover[k:k + size] = b"\1" * size
    return sum(cover) / len(value)


def _hashed(words: list[bytes], buckets: int) -> list[float]:
    out = [0.0] * buckets
    for w in words:
        out[zlib.crc32(w.lower()) % buckets] = 1.0
    return out


def _features(value: bytes, before: bytes, after: bytes, path: str, known: set[str]) -> list[float]:
    kind = CLASS[np.frombuffer(value, np.uint8)]
    n, share = len(value), np.bincount(kind, minlength=4) / len(value)
    _, count = np.unique(np.frombuffer(value, np.uint8), return_counts=True)
    p = count / n
    hexadecimal = sum(c in b"0123456789abcdefABCDEF" for c in value) / n
    two, one = _WORD.findall(before)[-2:], _WORD.findall(after)[:1]
    return [float(n), *share.tolist(), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, len(count) / n,
            float(-(p * np.log2(p)).sum()), hexadecimal, _covered(value.decode("latin-1"), known),
            float(b"=" in before[-4:]), float(before[-1:] in (b'"', b"'")), float(after[:1] in (b'"', b"'")),
            float(before[-1:] in (b"@", b".", b"+")), float(after[:1] in (b"@", b".")),
            *_hashed(two[-1:], WORD_BUCKETS), *_hashed(two[:-1], WORD_BUCKETS), *_hashed(one, WORD_BUCKETS),
            *_hashed(re.split(rb"[^a-z0-9]+", path.lower().encode()) if path else [b""], PATH_BUCKETS)]


def candidates(docs: DataFrame, known_words: list[str]) -> DataFrame:
    """All candidates of ``docs`` (``doc_id``, ``source``, ``text``): ``doc_id``, ``digest`` (MD5 of the text),
    ``start`` and ``end`` (code points, end excluded), ``value``, ``label``, ``features``."""
    import hashlib
    known = set(known_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "start", "end", "value", "label", "features"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64())]
        for b in batches:
            ids, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, _, buf, offs in _chunks(b, 2):
                start, end = _runs(RUN[buf], offs)
                digits = np.concatenate([[0], np.cumsum(DIGIT[buf])])
                ok = (end - start >= LONG) | ((end - start >= LEAST) & (digits[end] > digits[start]))
                start, end, raw = start[ok], end[ok], buf.tobytes()
                told = np.array(_told(raw, np.flatnonzero((buf == 0x3A) | (buf == 0x3D)), offs), np.int64).reshape(-1, 2)
                sure = np.concatenate([np.zeros(len(start), bool), np.ones(len(told), bool)])
                start, end = np.concatenate([start, told[:, 0]]), np.concatenate([end, told[:, 1]])
                if not len(start):
                    continue
                order = np.argsort(start, kind="stable")
                start, end, sure = start[order], end[order], sure[order]
                new = np.ones(len(start), bool)  # what overlaps is one candidate
                new[1:] = start[1:] >= np.maximum.accumulate(end)[:-1]
                new = np.flatnonzero(new)
                start, end, sure = start[new], np.maximum.reduceat(end, new), np.logical_or.reduceat(sure, new)
                row = np.searchsorted(offs, start, "right") - 1
                points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
                out = [[] for _ in names]
                digest = {}
                for s, e, r, told in zip(start.tolist(), end.tolist(), row.tolist(), sure.tolist(), strict=True):
                    lo, hi = int(offs[r]), int(offs[r + 1])
                    if r not in digest:
                        digest[r] = hashlib.md5(raw[lo:hi]).hexdigest()
                    value, before, after = raw[s:e], raw[max(lo, s - 48):s], raw[e:min(hi, e + 24)]
                    for o, v in zip(out, (ids[a + r], digest[r], int(points[s] - points[lo]), int(points[e] - points[lo]),
                                          value.decode(errors="replace"), float(told),
                                          _features(value, before, after, sources[a + r] or "", known)), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=names)
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(
        tidy(run), "doc_id long, digest string, start long, end long, value string, label double, features array<double>")


def train(found: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest of about ``sample`` different labelled ``candidates`` (half of either kind if there
    are so many); none if a kind is missing."""
    finding = F.xxhash64("value", "digest", "start")
    sizes = {r.label: r.n for r in found.select("label", finding.alias("finding")).distinct()
             .groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    place = F.pmod(finding, F.lit(1 << 40))
    limit = F.when(F.col("label") == 1, F.lit(min(1 << 40, (1 << 39) * sample // sizes[1.0]))).otherwise(
        F.lit(min(1 << 40, (1 << 39) * sample // sizes[0.0])))
    # In an order of its own: the forest's own sampling follows the rows.
    rows = found.filter(place < limit).groupBy("digest", "start", "value", "label").agg(F.min("features").alias("features"))
    rows = stored(rows.orderBy("digest", "start", "value").coalesce(1).select("label", "features")).withColumn("x", array_to_vector("features"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                  featureSubsetStrategy="onethird").fit(rows)


def judge(found: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``score`` (share of the forest's votes for a secret; without a forest the label)."""
    if forest is None:
        return found.withColumn("score", F.col("label"))
    scored = forest.transform(found.withColumn("x", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of ``docs``: ``doc_id``, ``digest``, ``start``, ``end``, ``value``, ``score`` (above one half)."""
    ship_package(docs.sparkSession)
    found = stored(candidates(docs, dictionary(docs)))
    scored = judge(found, train(found)).withColumn("score", F.greatest("score", "label"))
    return scored.filter("score > 0.5").drop("features", "label")


def redact(docs: DataFrame, secrets: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK`` and ``n_chars`` to match."""
    spans = secrets.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
                           F.col("digest").alias("_digest"), "start", "end").distinct()
    spans = stored(spans.groupBy("_id", "_digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")))
    spans = small_side(spans, BROADCAST_ROWS)
    keyed = docs.select("*", *row_key())
    # What stands between the spans, and the rest behind the last one.
    step = F.aggregate(
        "_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                     F.lit(MASK)).alias("out"), s["end"].alias("at")))
    text = F.concat(step["out"], F.substring("text", (step["at"] + 1).cast("int"), F.length("text")))
    out = keyed.join(spans, ["_id", "_digest"], "left").withColumn(
        "text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
