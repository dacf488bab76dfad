"""Text-side scoring stage: per-task naive Bayes heads over the corpus
tokenizer, logits for every split row, predictions (L2/L3 inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import counting as ct
from ..operators import heads as hd
from ..operators.common import r6
from .prepare import Prepared


class NBScores:
    """Logits of the per-task NB heads for every split row of ``p``.

    Model, priors and logits are materialised.  The token counts inside each row are those of ``Prepared.counted``;
    rows of one key are counted together (``grouped``, a row for each token), the others (``alone``) by themselves.
    """

    def __init__(self, p: Prepared, materialize: bool = True):
        from .stages import materialize as mat
        keep = mat if materialize else (lambda d: d)
        self.p = p
        self.counted = p.counted()
        self.rows = self.counted.select("task", "split", "id", "label_idx")
        self.max_classes = self._max_classes()
        self.repeated = ct.repeated_keys(self.counted, keep)
        self.alone = self.counted
        if self.repeated is not None:
            self.grouped = keep(ct.grouped_counts(self.counted, self.repeated))
            self.alone = ct.with_keys(self.counted, self.repeated, "left_anti")
        train = hd.nb_totals(self.alone.filter(F.col("split") == "train"))
        if self.repeated is not None:
            train = train.unionByName(self.grouped.filter(F.col("split") == "train").select("task", "token", "label_idx", "cnt"))
        model, prior = hd.fit_nb(train, self.rows.filter(F.col("split") == "train"), p.label_dim,
                                 self.max_classes)
        self.model, self.prior = keep(model), keep(prior)
        self.logits = keep(self._score(keep))

    @classmethod
    def get(cls, p: Prepared) -> NBScores:
        from .stages import stage
        return stage(p.spark, p.sf_dir, "nb", lambda: cls(p))

    def _score(self, keep) -> DataFrame:
        """Rows of unique keys are scored by the counts they carry, the others by those of their key."""
        own = hd.nb_score_counted(self.alone, self.model, self.prior, self.max_classes, keep)
        if self.repeated is None:
            return own
        again = ct.with_keys(self.rows, self.repeated, "left_semi")
        return own.unionByName(hd.nb_score(again, self.grouped, self.model, self.prior, self.max_classes))

    def _max_classes(self) -> int:
        row = self.p.label_dim.agg(F.max("label_idx").alias("m")).first()
        return int(row["m"]) + 1 if row["m"] is not None else 1

    def predictions(self) -> DataFrame:
        """Predicted class index per row (first index on ties)."""
        return self.logits.withColumn("pred_idx", ar.argmax("logits"))


def nb_priors(spark, sf_dir):
    s = NBScores.get(Prepared.get(spark, sf_dir))
    return s.prior.select("task", F.posexplode("log_prior").alias("class_idx", "lp")).select(
        "task", F.col("class_idx").cast("bigint").alias("class_idx"), r6("lp").alias("log_prior"))


def nb_logits(spark, sf_dir):
    s = NBScores.get(Prepared.get(spark, sf_dir))
    return s.logits.select("task", "split", "id", F.posexplode("logits").alias("class_idx", "logit")).select(
        "task", "split", "id", F.col("class_idx").cast("bigint").alias("class_idx"), r6("logit").alias("logit"))


def nb_predictions(spark, sf_dir):
    s = NBScores.get(Prepared.get(spark, sf_dir))
    return s.predictions().select("task", "split", "id", F.col("label_idx").cast("bigint").alias("label_idx"),
                                  F.col("pred_idx").cast("bigint").alias("pred_idx"))


def ngram_features(spark, sf_dir):
    """H4 over the ``lang`` task rows (whole texts)."""
    from ..config import NGRAM_BUCKETS, NGRAM_SIZES
    from ..operators import examples as ex
    e = ex.load_examples(spark, sf_dir, tasks=["lang"]).select("kind", "id", "text_a")
    f = hd.ngram_features(e, NGRAM_SIZES, NGRAM_BUCKETS)
    cols = []
    for n in NGRAM_SIZES:
        cols.append(F.size(f"b{n}").cast("bigint").alias(f"n{n}"))
        cols.append(F.array_join(F.array_sort(f"b{n}").cast("array<string>"), " ").alias(f"b{n}"))
    return f.select("kind", "id", *cols)


def _logreg_stage(spark, sf_dir):
    """Per-task softmax regression, fitted together by gradient steps; predictions of train and dev rows."""
    from .stages import materialize, stage
    from .training import Training
    return stage(spark, sf_dir, "logreg", lambda: materialize(Training.get(spark, sf_dir).final_scores()))


def logreg_predictions(spark, sf_dir):
    """Predictions for the dev split by the heads of the last evaluation."""
    return _logreg_stage(spark, sf_dir).filter(F.col("split") == "dev").select(
        "task", "id", F.col("label_idx").cast("bigint").alias("label_idx"), F.col("pred_idx").cast("bigint").alias("pred_idx"))


def logreg_check(spark, sf_dir):
    """H12 by facts that hold for any sound fit: one prediction per dev row,
    all in the label dictionary, and train rows no less often right than the commonest label."""
    p = Prepared.get(spark, sf_dir)
    pred = _logreg_stage(spark, sf_dir)
    known = pred.filter(F.col("split") == "dev").join(
        p.label_dim.select("task", F.col("label_idx").cast("bigint").alias("pred_idx"), "label"), ["task", "pred_idx"], "left")
    facts = known.groupBy("task").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.countDistinct("id").cast("bigint").alias("n_ids"),
        F.bool_and(F.col("label").isNotNull()).alias("in_dictionary"))
    train = pred.filter(F.col("split") == "train").groupBy("task", "label_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("pred_idx") == F.col("label_idx")).cast("int")).alias("right"))
    fit = train.groupBy("task").agg((F.sum("right") >= F.max("n")).alias("beats_majority"))
    return facts.join(fit, "task").select("task", "n", "n_ids", "in_dictionary", "beats_majority")


# Which head serves which task.
DISPATCH = {"quality": "nb", "turns": "nb", "lang": "majority"}


def dispatch(spark, sf_dir):
    """B8/2.L: every row scored by the registered head of its task."""
    from ..registry import dispatch as by_task
    s = NBScores.get(Prepared.get(spark, sf_dir))
    out = by_task(s.logits, DISPATCH, prior=s.prior)
    return out.select("task", "split", "id", F.col("pred_idx").cast("bigint").alias("pred_idx"))
