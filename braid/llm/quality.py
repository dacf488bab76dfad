"""Quality of texts by compression with zstandard dictionaries.

One dictionary is built from texts labelled good, one from texts labelled bad.  A text is cut into
windows of ``WINDOW`` bytes, each compressed with either dictionary and with none.  What the good dictionary
needs more than the bad one, divided by the larger of both sizes, is the normalised difference: of
the whole text, of the window most like bad texts and of the one most like good ones.  With the compressibility of the
windows by themselves (a text that repeats itself needs no dictionary) they go into a logistic regression, which
makes a probability of label 1 of them; values beyond those it has learnt from count as the nearest of them.  It is fitted on texts the dictionaries have not seen, and label
shares are those of all different labelled texts.

The model learns from a bounded sample: about ``SAMPLE_TEXTS`` different texts of each label, chosen by
a hash of the text, and of each at most ``SAMPLE_WINDOWS`` windows spread evenly over it.  ``score`` reads whole
texts, and nothing but them.

Defined results.  Null and empty texts have no windows and get the share of label 1.  With one label only that
share is 1 or 0 for every text; without labelled texts it is 0.5.  Labels other than 0 and 1, null ids, and null or empty texts
teach nothing; a document with several labels teaches each.  Equal texts get equal scores; repeated rows
are scored as often as they occur.  Empty table: empty result.  ``score`` carries other columns and replaces those named ``score`` and ``predicted``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import ship_package, small_batches, stored, tidy

SAMPLE_TEXTS, SAMPLE_WINDOWS = 3000, 64
WINDOW, LEAST_WINDOW = 512, 128
DICTIONARY_BYTES, LEVEL = 32 << 10, 3
# Segment and match length of the dictionary builder.
SEGMENT, MATCH = 64, 8
RIDGE, STEPS = 0.1, 60
GOOD = 0.7
FEATURES = 4
PLACES = 1 << 40


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    return (text[a:a + size] for a in range(0, len(text), size))


def parameters() -> zstd.ZstdCompressionParameters:
    """Frames without anything but compressed data."""
    return zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False,
                                                     write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of ``pieces``; of too few to train one, the pieces themselves."""
    try:
        return zstd.train_dictionary(size, pieces, k=SEGMENT, d=MATCH, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(pieces)[-size:]


class Model:
    """Dictionaries, and the regression from ``features`` to the score."""

    def __init__(self, share: float, good: bytes = b"", bad: bytes = b""):
        self.share, self.good, self.bad = share, good, bad
        self.least = self.most = self.mean = np.zeros(FEATURES)
        self.scale = np.ones(FEATURES)
        self.weights: np.ndarray | None = None  # None: every text gets the share
        self._with = None

    def __getstate__(self):
        return {**vars(self), "_with": None}  # compressors stay where they were made

    def compressors(self) -> list[zstd.ZstdCompressor]:
        if self._with is None:
            how = parameters()
            self._with = [zstd.ZstdCompressor(compression_params=how)]
            for data in (self.good, self.bad):
                held = zstd.ZstdCompressionDict(data) if data else None
                if held:
                    held.precompute_compress(compression_params=how)
                self._with.append(zstd.ZstdCompressor(compression_params=how, dict_data=held))
        return self._with

    def features(self, pieces: list[bytes]) -> np.ndarray:
        """Differences of the whole, the worst and the best window, and the compressibility of the windows."""
        if not pieces:
            return np.zeros(FEATURES)
        size = np.array([len(p) for p in pieces])
        plain, good, bad = (np.array([len(c.compress(p)) for p in pieces]) for c in self.compressors())
        # The short rest of a text says little.
        large = size >= min(LEAST_WINDOW, size.max())
        gap = ((good - bad) / np.maximum(good, bad))[large]
        whole = (good - bad).sum() / np.maximum(good, bad).sum()
        return np.array([whole, gap.max(), gap.min(), -np.log((plain / size)[large].min())])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Logistic regression by Newton steps; each label counts by its share."""
        self.least, self.most = x.min(axis=0), x.max(axis=0)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        each = np.where(y == 1, self.share / y.mean(), (1 - self.share) / (1 - y.mean()))
        w, hold = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + hold, z.T @ (each * (y - p)) - RIDGE * w)
            w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        self.weights = w
        return self

    def score(self, text: bytes) -> float:
        if not text or self.weights is None:
            return self.share
        x = np.clip(self.features(list(windows(text))), self.least, self.most)
        z = (x - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))))


def train(texts: list[tuple[int, int, list[bytes]]], share: float) -> Model:
    """Model from rows of (label, half, windows): dictionaries from one half, the regression from the other."""
    def some(label: int, half: int | None = None) -> list[list[bytes]]:
        return [w for y, h, w in texts if y == label and half in (None, h)]
    if not some(0) or not some(1):
        return Model(share)
    # A label with few texts may have none in one half; then that half is everything.
    part = lambda label, half: some(label, half) or some(label)
    good, bad = (dictionary([p for w in part(label, 0) for p in w]) for label in (1, 0))
    model, rest = Model(share, good, bad), [part(0, 1), part(1, 1)]
    x = np.array([model.features(w) for label in rest for w in label])
    return model.fit(x, np.repeat([0.0, 1.0], [len(label) for label in rest]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS, most: int = SAMPLE_WINDOWS) -> Model:
    """Learns from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``quality``).  Labels
    meet the hashes of the texts; only the texts of the sample are read for more."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id"), "text").filter(F.length("text") > 0)
    digest = F.xxhash64("text").alias("_hash")
    told = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    rows = stored(texts.select("doc_id", digest).join(told, "doc_id").groupBy("quality", "_hash").agg(F.min("doc_id").alias("doc_id")))
    sizes = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(0.5)
    limit = F.when(F.col("quality") == 1, F.lit(PLACES * sample // sizes.get(1, 1))).otherwise(F.lit(PLACES * sample // sizes.get(0, 1)))
    # About twice ``sample`` rows, whatever the tables hold.
    drawn = rows.filter(F.pmod(F.xxhash64("_hash"), F.lit(PLACES)) < limit)
    found = texts.select("doc_id", "text", digest).join(F.broadcast(stored(drawn)), ["doc_id", "_hash"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for t in b.column("text").cast(pa.binary()):
                many = -(-len(t.as_py()) // WINDOW)
                at = np.unique(np.linspace(0, many - 1, min(many, most)).astype(np.int64))
                cut.append([t.as_py()[k * WINDOW:(k + 1) * WINDOW] for k in at])
            yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("_hash"), pa.array(cut, pa.list_(pa.binary()))],
                                             names=["quality", "_hash", "windows"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {(y, h): w for b in batches for y, h, w in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        model = train([(y, h >> 7 & 1, got[y, h]) for y, h in sorted(got)], sizes.get(1, 0) / sum(sizes.values()))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})
    cut = found.select("quality", "_hash", "text").mapInArrow(tidy(spread), "quality int, _hash long, windows array<binary>")
    row = cut.repartition(1).mapInArrow(tidy(learn), "model binary").first()
    return pickle.loads(bytes(row.model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``GOOD`` on) to every row, from its ``text`` alone."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index("text")).cast(pa.binary())
            got = [model.score(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(got, pa.float64()), pa.array([int(s >= GOOD) for s in got], pa.int32())],
                names=[*names, "score", "predicted"])
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.mapInArrow(tidy(run), schema)
