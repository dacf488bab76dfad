"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; none runs on fixed input alone.  Float outputs are rounded to 6 digits
and integer outputs are BIGINT so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEBUG_QUERY_ROWS
from ..operators import batching as bt
from ..operators import examples as ex
from ..operators import splits as sp
from ..operators import stats as st
from ..operators.common import r6
from . import prepare
from .prepare import Prepared

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REG[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REG)


register("split_summary")(prepare.split_summary)


# --- step 1: examples, label dictionary, counts, weights ---------------------

@register("examples")
def q_examples(spark, sf_dir):
    return ex.load_examples(spark, sf_dir)


@register("debug_head")
def q_debug_head(spark, sf_dir):
    """A4: the debug limit per task and split (here low enough to bite on small inputs)."""
    s = Prepared.get(spark, sf_dir).splits
    return ex.head_per_group(s, ["task", "split"], ["id"], DEBUG_QUERY_ROWS).select("task", "split", "id", "label")


@register("label_dim")
def q_label_dim(spark, sf_dir):
    return ex.build_label_dim(ex.load_examples(spark, sf_dir))


@register("encoded_labels")
def q_encoded_labels(spark, sf_dir):
    e = ex.load_examples(spark, sf_dir)
    return (ex.encode_labels(e, ex.build_label_dim(e))
            .select("task", "kind", "id", "label", "label_idx"))


@register("split_counts")
def q_split_counts(spark, sf_dir):
    return st.split_counts(Prepared.get(spark, sf_dir).splits)


@register("label_counts")
def q_label_counts(spark, sf_dir):
    return st.label_counts(ex.load_examples(spark, sf_dir))


@register("class_weights")
def q_class_weights(spark, sf_dir):
    cw = Prepared.get(spark, sf_dir).class_weights()
    return cw.select("task", "label", "n", r6("weight").alias("weight"), "freq_rank")


@register("task_proportions")
def q_task_proportions(spark, sf_dir):
    p = st.task_proportions(st.task_counts(ex.load_examples(spark, sf_dir)))
    return p.select("task", "n", r6("p").alias("p"))


# --- step 2: plan, quotas, split --------------------------------------------

@register("split_plan")
def q_split_plan(spark, sf_dir):
    p = Prepared.get(spark, sf_dir).plan
    return p.select("task", F.col("task_idx").cast("bigint").alias("task_idx"), "n", "batch_size",
                    "n_batches", "train_batches", "dev_n", r6("dev_fraction").alias("dev_fraction"))


@register("label_quota")
def q_label_quota(spark, sf_dir):
    return Prepared.get(spark, sf_dir).quota


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return Prepared.get(spark, sf_dir).splits.select("task", "id", "label", "split")


@register("anti_split")
def q_anti_split(spark, sf_dir):
    p = Prepared.get(spark, sf_dir)
    return sp.anti_split(p.keys.select("task", "id", "label"), p.splits.filter(F.col("split") == "dev"))


@register("split_check")
def q_split_check(spark, sf_dir):
    p = Prepared.get(spark, sf_dir)
    return sp.split_check(p.splits, p.examples)


@register("dev_split")
def q_dev_split(spark, sf_dir):
    p = Prepared.get(spark, sf_dir)
    return ex.get_split(p.encoded_splits(), "dev").select("task", "id", "label", "label_idx")


# --- step 3: batching ----------------------------------------------------------

@register("batches")
def q_batches(spark, sf_dir):
    p = Prepared.get(spark, sf_dir)
    return bt.assign_batches(p.splits, p.plan, epoch=1).select("task", "split", "id", "pos", "batch_id")


@register("lockstep")
def q_lockstep(spark, sf_dir):
    p = Prepared.get(spark, sf_dir)
    return bt.zip_batches(bt.assign_batches(p.splits, p.plan, epoch=2))


@register("submission_positions")
def q_positions(spark, sf_dir):
    p = Prepared.get(spark, sf_dir)
    return bt.submission_positions(p.splits.filter(F.col("split") == "test").select("task", "id"))


# --- step 4: tokens, vocabulary, trim, features -------------------------------

from ..functions import text as tx  # noqa: E402
from ..operators import features as fe  # noqa: E402
from .prepare import features_of  # noqa: E402


@register("tokens")
def q_tokens(spark, sf_dir):
    t = fe.token_table(ex.load_examples(spark, sf_dir))
    return t.select("task", "kind", "id", F.size("tokens_a").cast("bigint").alias("n_a"),
                    F.size("tokens_b").cast("bigint").alias("n_b"),
                    F.array_join("tokens_a", " ").alias("tokens_a"))


@register("vocab")
def q_vocab(spark, sf_dir):
    return features_of(Prepared.get(spark, sf_dir))[0].select(
        "token", "n", F.col("token_id").cast("bigint").alias("token_id"))


@register("pair_trim")
def q_pair_trim(spark, sf_dir):
    from ..config import task_by_name
    spec = task_by_name("turns")
    t = fe.token_table(ex.load_examples(spark, sf_dir, tasks=["turns"]))
    a2, b2 = tx.trim_pair("tokens_a", "tokens_b", spec.max_length, spec.max_a, spec.max_b)
    return t.select("kind", "id", F.size("tokens_a").cast("bigint").alias("len_a"),
                    F.size("tokens_b").cast("bigint").alias("len_b"),
                    F.array_join(a2, " ").alias("kept_a"), F.array_join(b2, " ").alias("kept_b"))


@register("pair_trim_longest")
def q_pair_trim_longest(spark, sf_dir):
    """Limits under which a pair can miss all head+tail cases and is cut from the longer side."""
    t = fe.token_table(ex.load_examples(spark, sf_dir, tasks=["turns"]))
    a2, b2 = tx.trim_pair("tokens_a", "tokens_b", 60, 10, 40)
    return t.select("kind", "id", F.size(a2).cast("bigint").alias("n_a"), F.size(b2).cast("bigint").alias("n_b"),
                    F.array_join(a2, " ").alias("kept_a"), F.array_join(b2, " ").alias("kept_b"))


def _features_out(f):
    return f.select("task", "split", "id", F.col("label_idx").cast("bigint").alias("label_idx"),
                    tx.joined("input_ids").alias("input_ids"),
                    tx.joined("attention_mask").alias("attention_mask"),
                    tx.joined("token_type_ids").alias("token_type_ids"))


@register("features")
def q_features(spark, sf_dir):
    return _features_out(features_of(Prepared.get(spark, sf_dir))[1])


@register("length_check")
def q_length_check(spark, sf_dir):
    return fe.check_lengths(features_of(Prepared.get(spark, sf_dir))[1])


# --- step 5: array kit, heads, predictions ------------------------------------

from . import textmodels as tm  # noqa: E402
from . import vectors as vx  # noqa: E402

for _name in ("array_kit", "centroids", "linear_scores", "linear_scores_join", "pool_first", "pool_max", "pool_attention",
              "layer_mix", "last_k_concat", "ensemble_mean", "mix_heads"):
    register(_name)(getattr(vx, _name))
for _name in ("nb_priors", "nb_logits", "nb_predictions", "ngram_features", "logreg_predictions", "logreg_check", "dispatch"):
    register(_name)(getattr(tm, _name))


# --- steps 6-8: losses, metrics, training log, weighting, monitor ---------------

from . import training as trn  # noqa: E402

for _name in ("cross_entropy", "focal", "focal_alpha", "dice", "batch_mean_loss", "loss_by_name",
              "confusion", "accuracy", "per_class_f1", "macro_f1", "evaluate", "decoded_predictions",
              "submission", "step_log", "dwa_weights", "dtp_weights", "uw_terms", "total_loss",
              "running_f1", "running_loss", "dev_eval", "best_so_far", "early_stop", "resume_point", "progress_log"):
    register(_name)(getattr(trn, _name))


# --- step 9: perturbations and robustness -------------------------------------

from . import robustness as rb  # noqa: E402

for _name in ("linear_grad", "fgm", "pgd", "freelb_init", "freelb", "robustness"):
    register(_name)(getattr(rb, _name))


# --- step 10: streaming monitors, TSV/Parquet round trip -----------------------

from . import streams as stq  # noqa: E402

for _name in ("stream_confusion", "stream_metrics", "stream_scores", "routed_sources", "raw_tsv_counts",
              "header_tsv_splits", "written_splits"):
    register(_name)(getattr(stq, _name))
