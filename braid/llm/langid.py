"""Language identification with error-correcting output codes.

Every language has a codeword of -1 and +1; each bit is one binary classifier
(logistic regression) over hashed byte trigrams of the lower-cased letters of a
text.  Up to seven languages get the exhaustive code (all different ways to
split them in two), more get random codewords far from each other.  A text's
bits are decoded with weighted losses: each language's loss is the sum over the
bits of the logistic loss of the bit's output against its codeword, weighted by
how well that classifier did in training, and the language with the smallest
loss is chosen.  ``score`` is its share in a softmax of the negative losses;
a lead over the second below ``AMBIGUOUS`` flags the text.

The classifiers learn from a bounded sample (about ``SAMPLE_ROWS`` different labelled texts, spread
over the ``MOST_LANGUAGES`` commonest languages, chosen by a hash of the text) inside one task; predictions
read whole texts and nothing else.

Defined results.  Null text, or one without letters: ``und``, score 0,
ambiguous.  Rows without a label teach nothing.  Without any labelled row every
text is ``und``.  Ties between languages go to the smaller name.  Equal texts
get equal results, and teach as one; rows are returned as often as they occur.  Empty table:
empty result.  ``identify`` carries extra columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored, tidy

SAMPLE_ROWS, LEAST_PER_LANGUAGE, MOST_LANGUAGES = 3000, 50, 200
PLACES = 1 << 40
BUCKETS = 4096
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.05, 5
MOST_EXHAUSTIVE, RANDOM_BITS = 7, 40
AMBIGUOUS = 0.02
UNKNOWN = "und"
CHUNK = 1 << 18

# Bytes as read: small letters for capitals, one mark for all that is no letter
# in ASCII; bytes of other characters stay.
READ = np.full(256, 0x20, np.uint8)
READ[0x61:0x7B] = np.arange(0x61, 0x7B)
READ[0x41:0x5B] = np.arange(0x61, 0x7B)
READ[0x80:] = np.arange(0x80, 0x100)


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of hashed trigrams, one row per text (rows of texts under three bytes are zero)."""
    n = len(texts)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    b = READ[np.frombuffer(b"".join(texts), np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
    row = np.repeat(np.arange(n), np.diff(offs))[:-2]
    # No trigram of marks alone, none across two texts.
    ok = ~((b[:-2] == 0x20) & (b[1:-1] == 0x20) & (b[2:] == 0x20))
    for back in (1, 2):
        at = offs[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    count = np.bincount(row[ok] * BUCKETS + code[ok], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    # Square roots temper words that a text repeats.
    count = np.sqrt(count)
    return count / np.maximum(np.sqrt((count * count).sum(axis=1, keepdims=True)), 1e-9)


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and +1 for every language."""
    if languages <= MOST_EXHAUSTIVE:
        bits = max(1, 2 ** (languages - 1) - 1)
        first = np.ones((1, bits))
        rest = [[1 if (b >> (languages - 2 - i)) & 1 else -1 for b in range(bits)] for i in range(languages - 1)]
        return np.vstack([first, *[np.array(r)[None] for r in rest]]) if languages > 1 else first
    g, best, far = np.random.default_rng(SEED), None, -1
    for _ in range(50):  # the draw whose closest two codewords are farthest apart
        code = g.choice([-1.0, 1.0], (languages, max(RANDOM_BITS, int(10 * np.log2(languages)))))
        gap = ((code.shape[1] - code @ code.T) / 2 + np.eye(languages) * 1e9).min()
        if gap > far:
            best, far = code, gap
    return best


class Model:
    """Languages, codewords, linear classifiers and weights of the bits."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.code = codewords(len(languages))
        self.w = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        self.weight = np.ones(self.code.shape[1])

    def fit(self, x: np.ndarray, language: np.ndarray) -> Model:
        """Logistic regression of every bit, by Adam over shuffled batches."""
        g, y = np.random.default_rng(SEED), self.code[language].astype(np.float32)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.b)]
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = g.permutation(len(x))
            for a in range(0, len(x), BATCH):
                some, step = order[a:a + BATCH], step + 1
                z = (x[some] @ self.w + self.b) * y[some]
                d = -y[some] / (1 + np.exp(np.clip(z, -30, 30))) / len(some)
                for p, grad, s in ((self.w, x[some].T @ d, state[0]), (self.b, d.sum(axis=0), state[1])):
                    s[0] += 0.1 * (grad - s[0])
                    s[1] += 0.001 * (grad * grad - s[1])
                    p -= rate * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.999 ** step)) + 1e-8)
        right = ((x @ self.w + self.b) * y > 0).mean(axis=0)
        # A bit no better than guessing weighs nothing.
        self.weight = np.maximum(2 * right - 1, 1e-3)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, lead over the second) of every row."""
        out = (x @ self.w + self.b).astype(np.float64)
        loss = np.stack([(np.logaddexp(0, -out * c) * self.weight).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        order = np.sort(share, axis=1)
        lead = order[:, -1] - order[:, -2] if share.shape[1] > 1 else order[:, -1]
        return best, share[np.arange(len(x)), best], lead


def train(texts: list[str], languages: list[str]) -> Model | None:
    names = sorted(set(languages))
    if not names:
        return None
    x = np.concatenate([features([t.encode() for t in texts[a:a + 256]]) for a in range(0, len(texts), 256)])
    return Model(names).fit(x, np.searchsorted(names, languages))


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE_ROWS, most: int = MOST_LANGUAGES) -> Model | None:
    """Learns the ``most`` commonest languages of ``docs`` (``text``, ``lang``) from about
    ``sample`` different texts, at least ``LEAST_PER_LANGUAGE`` per language if there are so many."""
    ship_package(docs.sparkSession)
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("_hash"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_texts"), F.count(F.lit(1)).alias("_rows"))
    learnt = stored(sizes.orderBy(F.desc("_rows"), "lang").limit(most))
    per = max(LEAST_PER_LANGUAGE, sample // max(1, learnt.count()))
    # Copies of a text are drawn together and count once.
    place, limit = F.pmod(F.xxhash64("_hash"), F.lit(PLACES)), F.lit(PLACES * per) / F.greatest("_texts", F.lit(per))
    drawn = rows.join(F.broadcast(learnt), "lang").filter(place < limit).groupBy("lang", "_hash").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                        if has_letters(r[0])), key=lambda r: (r[1], r[0]))
        model = train([t for t, _ in found], [x for _, x in found])
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model and vars(model))]})
    row = drawn.select("text", "lang").repartition(1).mapInArrow(tidy(run), "model binary").first()
    state = pickle.loads(bytes(row.model)) if row else None
    if not state:
        return None
    model = Model.__new__(Model)
    vars(model).update(state)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``ambiguous`` to every row, from its ``text`` alone
    (replacing columns of these names)."""
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = [f.name for f in docs.schema.fields]
    return docs.mapInArrow(tidy(_identifier(model, names)), _schema(docs))


def _schema(docs: DataFrame):
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
    return StructType([*docs.schema.fields, StructField("lang_pred", StringType()),
                       StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])


def _identifier(model: Model | None, names: list[str]):
    def predict(texts: list[bytes]) -> tuple[list, list, list]:
        known = np.array([bool(model) and has_letters(t.decode()) for t in texts])
        if not known.any():
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        best, score, lead = model.decode(features(texts))
        return ([model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)],
                np.where(known, score, 0.0).tolist(), (~known | (lead < AMBIGUOUS)).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, part, size = ([], [], []), [], 0
            texts = b.column(names.index("text")).cast(pa.binary())
            for k, t in enumerate(texts):
                part.append(t.as_py() or b"")
                size += len(part[-1])
                if size > CHUNK or len(part) == 256 or k + 1 == b.num_rows:
                    for o, x in zip(out, predict(part), strict=True):
                        o.extend(x)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())],
                names=[*names, "lang_pred", "score", "ambiguous"])
    return run
