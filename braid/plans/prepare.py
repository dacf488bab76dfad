"""L1 (prepare data) as one lazy chain: examples -> counts -> plan -> quotas
-> stratified split.  Shared by the query catalog, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MIN_DEV_PCT, SPLIT_SEED, TOTAL_BATCH_SIZE
from ..operators import examples as ex
from ..operators import splits as sp
from ..operators import stats as st
from ..operators.common import checked_broadcast, r6


class Prepared:
    """Tables of the prepare stage for one ``sf_dir``.

    ``keys`` (ids, labels and order keys of the labelled rows, no texts), the
    split table (partitioned by task and split), plan, quotas and label
    dictionary are materialised once because every later stage reads them.
    The sources are read once for the keys, without texts, and once for the
    split table.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, batch_size: int = TOTAL_BATCH_SIZE,
                 min_pct: float = MIN_DEV_PCT, seed: int = SPLIT_SEED, materialize: bool = True):
        from .stages import materialize as mat
        keep = mat if materialize else (lambda d: d)
        self.spark, self.sf_dir, self.seed = spark, sf_dir, seed
        self.examples = ex.load_examples(spark, sf_dir)
        self.keys = keep(sp.split_keys(self.examples, seed))
        # The label histogram of the keys gives the plan, the quotas, the
        # label dictionary and the class weights.
        self.label_counts = keep(sp.key_counts(self.keys))
        w = Window.partitionBy("task").orderBy("label")
        self.label_dim = keep(self.label_counts.select(
            "task", "label", (F.row_number().over(w) - 1).cast("int").alias("label_idx")))
        splits, self.plan, self.quota = sp.split_examples(
            self.examples, batch_size, min_pct, seed, lcounts=self.label_counts, keep=keep, keys=self.keys)
        if materialize:
            from ..sources.tables import read_table
            from .stages import spread
            splits = mat(spread(splits, *(read_table(spark, sf_dir, t).select(c) for t, c in (
                ("documents", "doc_id"), ("conversations", "conv_id")))), ("task", "split"))
        self.splits = splits

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> Prepared:
        """Session-memoised default instance."""
        from .stages import stage
        return stage(spark, sf_dir, "prepared", lambda: cls(spark, sf_dir))

    def class_weights(self) -> DataFrame:
        """D4 from the materialised label counts."""
        return st.class_weights(self.label_counts)

    def encoded_splits(self) -> DataFrame:
        """Split rows with ``label_idx`` (an unknown label fails the query)."""
        return ex.encode_labels(self.splits, checked_broadcast(self.label_dim))

    def counted(self) -> DataFrame:
        """Split rows with the tokens of their whole texts counted inside the row instead of the texts.  The vocabulary, the NB
        and the gradient heads all read it."""
        from ..operators.counting import counted_rows
        return self._by_texts("counted", lambda rows: counted_rows(rows).drop("counts", "slots"))

    def framed(self) -> DataFrame:
        """Split rows with the framed sequences the features need instead of the texts."""
        from ..operators.counting import framed_rows
        return self._by_texts("framed", framed_rows)

    def _by_texts(self, name: str, make) -> DataFrame:
        from .stages import materialize_by, stage

        def build():
            rows = self.encoded_splits()
            return materialize_by(lambda split: make(rows.filter(F.col("split") == split)), "split", ("train", "dev", "test"))
        return stage(self.spark, self.sf_dir, name, build)


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: rows per task x split x label with the label's class weight."""
    p = Prepared.get(spark, sf_dir)
    cw = p.class_weights().select("task", "label", "weight")
    counts = p.splits.groupBy("task", "split", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return (counts.join(checked_broadcast(cw), ["task", "label"], "left")
            .select("task", "split", "label", "n", r6("weight").alias("class_weight")))


def features_of(p: Prepared, max_size: int | None = None):
    """L1 steps 5-6: vocabulary from the train split and features of every
    split row.  Returns (vocab, features)."""
    from ..operators import features as fe
    from .stages import materialize, stage
    build = lambda: materialize(fe.build_vocab(p.counted(), max_size))
    vocab = stage(p.spark, p.sf_dir, "vocab", build) if max_size is None else build()
    return vocab, fe.encode(p.framed(), vocab)
