"""Scoring and pooling heads over vector and token tables.

The neural layers are not trained; the aggregation each head performs is.

Vector sequences: the ``embeddings`` table has one vector per row.  Heads that
pool over positions (or layers) view ``vec_id div 8`` as the sequence id and
``vec_id mod 8`` as the position/layer (``SEQ_LEN`` = 8).  Layers (H5, H6) are a fixed number, so
their ``collect_list`` is bounded.  Pooling over positions (H2, H3) and mixing heads by
a gate (H8) take any number of members: blocks of ``BLOCK`` members are folded
into one state, states into one again, until each sequence has one (``folded``).

Linear models (centroids) have ``classes x dim`` parameters.  They are fitted
with a partial aggregate.  A model of checked size is fetched to the driver
(like an MLlib coefficient vector) and applied as one literal matrix inside
a projection: scoring needs no join and no shuffle.  A larger model is joined
in blocks of classes.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as ar
from ..functions import text as tx
from ..session import ship_package
from . import nb_batches as nb
from . import ngrams as ng
from .common import checked_broadcast

SEQ_LEN = 8
MAX_MODEL_CELLS = 1_000_000


# --- sequences over the vector table ---------------------------------------

def as_sequences(vecs: DataFrame) -> DataFrame:
    """(seq_id, pos, embedding) with ``seq_id = vec_id div 8``, ``pos = vec_id mod 8``."""
    return vecs.select(F.floor(F.col("vec_id") / SEQ_LEN).cast("bigint").alias("seq_id"),
                       F.pmod(F.col("vec_id"), F.lit(SEQ_LEN)).cast("int").alias("pos"),
                       "embedding")


def _members(seqs: DataFrame) -> DataFrame:
    """One row per sequence with its members sorted by position (<= 8)."""
    return seqs.groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("m"))


def pool_first(seqs: DataFrame) -> DataFrame:
    """H1: vector at the first position (CLS pooling)."""
    return seqs.groupBy("seq_id").agg(F.min_by("embedding", "pos").alias("pooled"))


# Members folded into one state at a time.
BLOCK = 64


def folded(members: DataFrame, key: str, merge, block: int = BLOCK) -> DataFrame:
    """``members`` (``key``, ``state``) merged to one ``state`` per key.  ``merge``: the state of an array of
    states; it must not matter how they are grouped.  The first round takes neighbouring rows of a partition, later
    ones deal a key's states out evenly; no group of more than about ``block`` is ever collected."""
    from ..plans.stages import materialize
    def states(part: Column | None) -> DataFrame:
        keys = [key] if part is None else [key, part.alias("_part")]
        return members.groupBy(*keys).agg(F.collect_list("state").alias("_states")).withColumn("state", merge(F.col("_states"))).drop("_states")
    largest = members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.call_function("div", F.monotonically_increasing_id(), F.lit(block))
    if largest > block:
        members = materialize(states(part))
        largest = members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    while largest > block:
        parts = -(-largest // block)
        members, largest = materialize(states(F.pmod(F.xxhash64("_part"), F.lit(parts)))), parts
    return states(None)


def softmax_state(score, vector) -> Column:
    """One member of a softmax-weighted sum: the largest score, the sum of exponentials and the weighted vector, both
    relative to it."""
    return F.struct(F.col(score).cast("double").alias("top"), F.lit(1.0).alias("total"), F.col(vector).cast("array<double>").alias("vector"))


def merge_softmax(states: Column) -> Column:
    """Online softmax: states brought to their common largest score and added."""
    def at(top):
        share = lambda s: F.exp(s["top"] - top)
        total = F.aggregate(states, F.lit(0.0), lambda a, s: a + s["total"] * share(s))
        zero = F.transform(F.element_at(states, 1)["vector"], lambda x: F.lit(0.0))
        vector = F.aggregate(states, zero, lambda a, s: ar.add(a, ar.scale(s["vector"], share(s))))
        return F.struct(top.alias("top"), total.alias("total"), vector.alias("vector"))
    return ar.let(F.array_max(F.transform(states, lambda s: s["top"])), at)


def softmax_mean(members: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(``key``, ``mean``): the members' vectors weighted by the softmax of their scores."""
    got = folded(members, key, merge_softmax, block)
    return got.select(key, ar.scale(F.col("state.vector"), 1 / F.col("state.total")).alias("mean"))


def pool_max(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """H3: element-wise max over positions; members without a vector take no part."""
    def merge(states):
        return F.aggregate(states, F.element_at(states, 1), lambda a, x: F.zip_with(a, x, lambda y, z: F.greatest(y, z)))
    members = seqs.filter("embedding IS NOT NULL").select("seq_id", F.col("embedding").alias("state"))
    return folded(members, "seq_id", merge, block).select("seq_id", F.col("state").alias("pooled"))


def pool_attention(seqs: DataFrame, w, block: int = BLOCK) -> DataFrame:
    """H2: ``relu(sum_p softmax_p(x_p . w) x_p)`` over any number of positions; members without a vector take no part."""
    members = seqs.filter("embedding IS NOT NULL").withColumn("_score", ar.dot("embedding", ar.lit_vector(w)))
    got = softmax_mean(members.select("seq_id", softmax_state("_score", "embedding").alias("state")), "seq_id", block)
    return got.select("seq_id", F.transform("mean", lambda x: F.greatest(x, F.lit(0.0))).alias("pooled"))


def layer_weights(n_layers: int = SEQ_LEN) -> list[float]:
    """H5 initial layer logits: -3 for every layer but the last, 0 for it."""
    return [-3.0] * (n_layers - 1) + [0.0]


def layer_mix(seqs: DataFrame, logits=None) -> DataFrame:
    """H5: ``sum_l softmax(logits)_l x_l`` over layers (positions)."""
    lg = logits or layer_weights()
    wl = ar.softmax(ar.lit_vector(lg))
    m = _members(seqs)
    dim = F.size(F.element_at("m", 1)["embedding"])
    zero = F.array_repeat(F.lit(0.0), dim)
    pooled = F.aggregate(F.col("m"), zero,
                         lambda acc, s: ar.add(acc, ar.scale(s["embedding"], F.element_at(wl, s["pos"] + 1))))
    return m.select("seq_id", pooled.alias("pooled"))


def last_k_concat(seqs: DataFrame, k: int = 4) -> DataFrame:
    """H6: concatenation of the last ``k`` layers, last layer first."""
    m = _members(seqs)
    rev = F.reverse("m")
    return m.select("seq_id", F.flatten(F.transform(F.slice(rev, 1, k), lambda s: s["embedding"])).alias("pooled"))


# --- linear heads -------------------------------------------------------------

def fit_centroids(vecs: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Per class the mean vector (closed-form head) and the bias
    ``-||c||^2 / 2`` that makes ``argmax(W x + b)`` the nearest centroid.

    One partial aggregate of whole vectors (MLlib's summariser)."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col)))
    cen = vecs.groupBy(F.col(label_col).alias("label")).agg(vector_to_array(mean).alias("centroid"))
    return cen.withColumn("bias", -0.5 * ar.sumsq("centroid"))


def _logits(x: Column, W: Column, b: Column) -> Column:
    """``W x + b`` for a matrix and a vector column (or literal)."""
    return F.zip_with(W, b, lambda w, c: ar.dot(x, w) + c)


class LinearModel:
    """A small fitted linear head: ``classes`` (sorted labels), ``W``, ``b``."""

    def __init__(self, classes, W, b):
        self.classes, self.W, self.b = list(classes), [list(r) for r in W], list(b)

    @classmethod
    def from_centroids(cls, cen: DataFrame, max_cells: int = MAX_MODEL_CELLS) -> LinearModel:
        """Fetches a model of checked size; a larger one is scored with ``join_scores``."""
        n, dim = cen.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
        if n * (dim or 0) > max_cells:
            raise ValueError(f"{n} classes x {dim} dimensions are too many to fetch; use join_scores")
        rows = sorted(cen.collect(), key=lambda r: r["label"])
        return cls([r["label"] for r in rows], [r["centroid"] for r in rows], [r["bias"] for r in rows])

    def logits(self, x) -> Column:
        """H9: ``W x + b`` as ARRAY<DOUBLE> (class order = ``classes``)."""
        return ar.let(x, lambda v: _logits(v, ar.lit_matrix(self.W), ar.lit_vector(self.b)))

    def grad(self, x, y_idx) -> Column:
        """Gradient of cross entropy w.r.t. x: ``sum_c (p_c - y_c) W_c``."""
        p = ar.softmax(self.logits(x))
        coef = F.zip_with(p, ar.one_hot(y_idx, len(self.classes)), lambda a, b: a - b)
        Wt = ar.lit_matrix([list(col) for col in zip(*self.W, strict=True)])
        # One dot product with the coefficients per dimension.
        return ar.let(coef, lambda c: F.transform(Wt, lambda col: ar.dot(col, c)))

    def label_index(self, label) -> Column:
        lab = F.col(label) if isinstance(label, str) else label
        expr = None
        for i, c in enumerate(self.classes):
            expr = F.when(lab == c, i) if expr is None else expr.when(lab == c, i)
        return expr.cast("int")


def linear_score(df: DataFrame, model: LinearModel, vec_col: str = "embedding") -> DataFrame:
    return df.withColumn("logits", model.logits(vec_col))


def join_scores(df: DataFrame, cen: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id",
                block: int = 1024) -> DataFrame:
    """H9 for a model of any size: (``id_col``, ``logits``) as ``linear_score``
    gives them.  The classes are cut into blocks of ``block`` in label order;
    each vector meets each block once and the pieces are put together by id."""
    ranked = cen.withColumn("_c", F.row_number().over(Window.orderBy("label")) - 1)  # one row per class
    blocks = (ranked.withColumn("_b", F.floor(F.col("_c") / block))
              .groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_c", "centroid", "bias"))).alias("m")))
    n = (cen.count() + block - 1) // block
    met = df.select(id_col, F.col(vec_col).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("_b"))
    piece = met.join(blocks, "_b").select(
        id_col, "_b", _logits(F.col("_x"), F.col("m.centroid"), F.col("m.bias")).alias("l"))
    return piece.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_b", "l"))).alias("p")).select(
        id_col, F.flatten(F.col("p.l")).alias("logits"))


def ensemble_mean(scores: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """H7: mean logit per (id, class) over ensemble members (long form)."""
    long = scores.select(id_col, F.posexplode("logits").alias("class_idx", "logit"))
    return long.groupBy(id_col, "class_idx").agg(F.avg("logit").alias("logit"))


def mix_heads(scores: DataFrame, gate_col: str = "gate", id_col: str = "seq_id", block: int = BLOCK) -> DataFrame:
    """H8: ``softmax(gate)`` over the heads of an id times each head's logits,
    summed per (id, class), for any number of heads."""
    members = scores.filter(F.col(gate_col).isNotNull() & F.col("logits").isNotNull()).select(
        id_col, softmax_state(gate_col, "logits").alias("state"))
    return softmax_mean(members, id_col, block).select(id_col, F.col("mean").alias("logits"))


# --- n-gram features (H4) -------------------------------------------------------

def ngram_features(df: DataFrame, sizes=(2, 3, 4, 5), buckets: int = 128) -> DataFrame:
    """H4: per row and n-gram size, the active buckets (fixed width
    ``len(sizes) * buckets`` when one-hot expanded), ascending.  Max pool =
    presence; every n-gram of the whole text is hashed (``ngrams``)."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ng.BATCH_BYTES))
    t = df.select(*[c for c in df.columns if c not in ("text_a", "text_b")], tx.tokenize("text_a").alias("_tokens"))
    schema = T.StructType([f for f in t.schema.fields if f.name != "_tokens"])
    for n in sizes:
        schema = schema.add(f"b{n}", T.ArrayType(T.LongType()))
    return t.mapInArrow(lambda batches: ng.bucket_batches(batches, sizes, buckets), schema)


# --- multinomial naive Bayes per task (H11, H13) --------------------------------

# A token with at least this share of a task's training tokens has its model row broadcast, if the rows are no more than
# ``HOT_BYTES`` together; else the share is doubled, and so on, at most to ``HOTTEST``.
HOT_SHARE, HOTTEST, HOT_BYTES = 1 / 4_000_000, 1 / 2000, 50_000_000


def occurrences(tokens: DataFrame, keys=("task", "split", "id", "label_idx")) -> DataFrame:
    """Tokens per row with multiplicity (``cnt``), whole texts.  The rows are
    dealt out by their key first, so counting inside a row needs no exchange of
    single tokens."""
    from .features import all_tokens
    keys = [k for k in keys if k in tokens.columns]
    rows = tokens.repartition("task", "split", "id")
    return (rows.select(*keys, F.explode(all_tokens(rows)).alias("token"))
            .groupBy("task", "split", "id", "token").agg(
                *[F.max(k).alias(k) for k in keys if k not in ("task", "split", "id")],
                F.count(F.lit(1)).cast("bigint").alias("cnt")))


def fit_nb(train_counts: DataFrame, train_rows: DataFrame, label_dim: DataFrame,
           max_classes: int) -> tuple[DataFrame, DataFrame]:
    """One multinomial NB head per task over the shared tokenizer.

    Returns ``(model, prior)``: ``model(task, token, ll ARRAY<DOUBLE>, share)`` with
    ``ll[c] = ln((n_wc + 1) / (N_c + V))``, the token's ``share`` of the task's training tokens, and ``prior(task, log_prior
    ARRAY<DOUBLE>)`` with ``ln(n_c / n)``; class slots follow ``label_dim``
    (task, label_idx).

    One partial aggregate per (task, token) produces all class counts at once
    (a conditional sum per class slot), so a hot token is combined map-side
    and no (token x class) grid is ever joined.  Per-task totals (N_c, V)
    come from that table and have one row per task (broadcast).
    """
    slots = [F.sum(F.when(F.col("label_idx") == k, F.col("cnt")).otherwise(0)).alias(f"_c{k}")
             for k in range(max_classes)]
    wc = (train_counts.groupBy("task", "token").agg(*slots)
          .select("task", "token", F.array(*[F.col(f"_c{k}") for k in range(max_classes)]).alias("n_w")))
    ncls = label_dim.groupBy("task").agg(F.count(F.lit(1)).cast("int").alias("n_cls"))
    per_task = (wc.groupBy("task").agg(
        F.count(F.lit(1)).alias("vsize"),
        *[F.sum(F.element_at("n_w", k + 1)).alias(f"_N{k}") for k in range(max_classes)])
        .select("task", "vsize", F.array(*[F.col(f"_N{k}") for k in range(max_classes)]).alias("n_tok"))
        .join(ncls, "task"))
    model = (wc.join(F.broadcast(per_task), "task")
             .select("task", "token", F.transform(
                 F.sequence(F.lit(1), F.col("n_cls")),
                 lambda k: F.log((F.element_at("n_w", k) + 1) / (F.element_at("n_tok", k) + F.col("vsize"))))
                 .alias("ll"), (ar.total("n_w") / ar.total("n_tok")).alias("share")))
    docs = train_rows.groupBy("task", "label_idx").agg(F.count(F.lit(1)).alias("n_docs"))
    cls = (label_dim.select("task", "label_idx").join(docs, ["task", "label_idx"], "left")
           .select("task", "label_idx", F.coalesce("n_docs", F.lit(0)).alias("n_docs")))
    tot = F.sum("n_docs").over(Window.partitionBy("task"))
    prior = (cls.select("task", "label_idx", F.log(F.col("n_docs") / tot).alias("lp"))
             .groupBy("task").agg(F.array_sort(F.collect_list(F.struct("label_idx", "lp"))).alias("_s"))
             .select("task", F.transform("_s", lambda s: s["lp"]).alias("log_prior")))
    return model, prior


def _hot_share(model: DataFrame) -> float:
    """The smallest share from ``HOT_SHARE`` on at which the model rows of hot tokens may be broadcast."""
    shares = [HOT_SHARE * 2 ** i for i in range(11)]
    size = F.length("token") + F.size("ll") * 20 + 50
    sums = model.agg(*[F.sum(F.when(F.col("share") >= s, size)).alias(f"_{i}") for i, s in enumerate(shares)]).first()
    return next((s for s, n in zip(shares, sums, strict=True) if (n or 0) <= HOT_BYTES), max(HOTTEST, shares[-1]))


def nb_score(rows: DataFrame, row_counts: DataFrame, model: DataFrame, prior: DataFrame,
             max_classes: int, keys=("task", "split", "id", "label_idx")) -> DataFrame:
    """``logits = log_prior + sum_tokens cnt * ll`` per row of ``rows``.

    Tokens outside the task's training vocabulary contribute nothing.  The
    token join is keyed by (task, token).  The model grows with the corpus, but not the rows of its hot tokens, those with a
    fixed share of all: these are broadcast, so no stop word gathers its occurrences in one task and
    most occurrences stay where they are; the rest is joined by a shuffle.  The per-row sum is an element-wise partial aggregate (one sum
    per class slot), so no token list is ever collected.
    """
    keys = [k for k in keys if k in rows.columns]
    hot_share = _hot_share(model)
    is_hot = checked_broadcast(model.filter(F.col("share") >= hot_share).drop("share"))
    hot = row_counts.join(is_hot, ["task", "token"])
    cold = (row_counts.join(is_hot.select("task", "token"), ["task", "token"], "left_anti")
            .join(model.filter(F.col("share") < hot_share), ["task", "token"]))
    j = hot.select("task", "split", "id", "cnt", "ll").unionByName(cold.select("task", "split", "id", "cnt", "ll"))
    sums = [F.sum(F.col("cnt") * F.try_element_at("ll", F.lit(k + 1))).alias(f"_s{k}") for k in range(max_classes)]
    g = j.groupBy("task", "split", "id").agg(*sums)
    out = (rows.select(*keys).join(checked_broadcast(prior), "task")
           .join(g, ["task", "split", "id"], "left"))
    return _with_prior(out, F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(max_classes)]), keys)


def _with_prior(rows: DataFrame, sums: Column, keys: list[str]) -> DataFrame:
    n = F.size("log_prior")
    logits = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda k: F.element_at("log_prior", k + 1) + F.element_at(sums, k + 1))
    return rows.select(*keys, logits.alias("logits"))


def _in_batches(rows: DataFrame, make, schema: str) -> DataFrame:
    ship_package(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ng.BATCH_BYTES))
    return rows.mapInArrow(make, schema)


def nb_totals(counted: DataFrame) -> DataFrame:
    """(``task``, ``token``, ``label_idx``, ``cnt``) of rows that carry their counts, added up in each batch, for ``fit_nb``."""
    return _in_batches(counted.select("task", "label_idx", "tokens", "times"), nb.total_batches, nb.TOTALS)


def nb_score_counted(counted: DataFrame, model: DataFrame, prior: DataFrame, max_classes: int, keep) -> DataFrame:
    """``nb_score`` of rows that carry their counts (see ``counting``) and whose keys are unique and not null.

    The model rows of hot tokens, of a bounded size, go to the workers, and a row's sum over them is made where the row is read
    (``nb_batches``); only occurrences of other tokens become rows, for the join with the rest of the model.  ``keep``: stores a frame
    and reads it again."""
    keys = ["task", "split", "id", "label_idx"]
    hot_share = _hot_share(model)
    held = counted.sparkSession.sparkContext.broadcast(nb.by_task(model.filter(F.col("share") >= hot_share).select("task", "token", "ll").toArrow()))
    part = keep(_in_batches(counted.select(*keys, "tokens", "times"),
                            lambda batches: nb.sum_batches(batches, held.value, max_classes), nb.SUMS))
    cold = part.select("task", "split", "id", F.explode("cold").alias("_t")).select("task", "split", "id", "_t.token", "_t.cnt")
    # By token first: rows are sorted by it, and the first bytes of a task's name tell none of its rows apart.
    cold = cold.join(model.filter(F.col("share") < hot_share).drop("share"), ["token", "task"])
    sums = [F.sum(F.col("cnt") * F.try_element_at("ll", F.lit(k + 1))).alias(f"_s{k}") for k in range(max_classes)]
    g = cold.groupBy("task", "split", "id").agg(*sums)
    out = part.drop("cold").join(checked_broadcast(prior), "task").join(g, ["task", "split", "id"], "left")
    return _with_prior(out, F.array(*[F.element_at("hot", i + 1) + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(max_classes)]), keys)


def majority(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """The class with the largest prior for every row of a task (the smallest index on ties)."""
    best = checked_broadcast(prior.select("task", ar.argmax("log_prior").alias("pred_idx")))
    return rows.join(best, "task")
