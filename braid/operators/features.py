"""Vocabulary and fixed-length token features.

Scale notes
* Tokenising is a JVM regex over whole texts (no prefix cut).
* The vocabulary count is a partial aggregate over exploded tokens; hot tokens
  are combined map-side.  Every token gets an id (a caller may ask for the
  ``max_size`` most frequent ones); ids come from a two-stage rank, never from
  one window over the whole vocabulary.
* Encoding truncates/trims *before* anything moves, shuffles one row per
  document by its key, and explodes inside that partitioning, so regrouping the
  ids needs no second exchange while the vocabulary is small enough to
  broadcast (rows and bytes are checked); a larger one is joined by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPECIAL_TOKENS, TASKS, UNK_ID
from ..functions import text as tx
from .common import checked_broadcast

# Ids below this one are looked up in a broadcast table.
HOT_IDS = 1_200_000


def token_table(df: DataFrame) -> DataFrame:
    """G1 per row: token arrays of both texts (whole texts).  A table that
    already carries ``tokens_a``/``tokens_b`` is returned as is."""
    if "tokens_a" in df.columns:
        return df
    return (df.withColumn("tokens_a", tx.tokenize("text_a"))
            .withColumn("tokens_b", F.when(F.col("text_b").isNotNull(), tx.tokenize("text_b"))))


def all_tokens(df: DataFrame) -> Column:
    """Tokens of text_a followed by those of text_b (empty when absent)."""
    t = token_table(df)
    return F.concat(F.col("tokens_a"), F.coalesce(F.col("tokens_b"), F.array().cast("array<string>")))


def build_vocab(splits: DataFrame, max_size: int | None = None, min_count: int = 1,
                split: str = "train") -> DataFrame:
    """(token, n, token_id); ids 0-3 are [PAD] [UNK] [CLS] [SEP], corpus
    tokens follow by count desc, token asc -- all of them, or the first
    ``max_size``."""
    from ..plans.ranking import range_rank
    from ..plans.stages import materialize
    src = splits.filter(F.col("split") == split) if split else splits
    if "tokens" in src.columns:  # counted inside the rows
        from .counting import token_counts
        toks = src.select(token_counts().alias("_t")).select("_t.token", F.col("_t.cnt").alias("_n"))
    else:
        src = token_table(src)
        toks = src.select(F.explode(all_tokens(src)).alias("token"), F.lit(1).alias("_n"))
    counts = toks.groupBy("token").agg(F.sum("_n").cast("bigint").alias("n")).filter(F.col("n") >= min_count)
    ranked = range_rank(materialize(counts), [], [F.col("n").desc(), "token"], "_rank")
    if max_size is not None:
        ranked = ranked.filter(F.col("_rank") <= max_size)
    ranked = ranked.select("token", "n", (F.col("_rank") + len(SPECIAL_TOKENS) - 1).cast("int").alias("token_id"))
    spark = splits.sparkSession
    special = spark.createDataFrame([(t, 0, i) for i, t in enumerate(SPECIAL_TOKENS)],
                                    "token string, n bigint, token_id int")
    return special.unionByName(ranked)


def _by_task(values: dict, default=None):
    expr = None
    for name, v in values.items():
        cond = F.col("task") == name
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(default) if default is not None else expr


def sequences(rows: DataFrame, tasks=TASKS) -> DataFrame:
    """Per row: the special-token-framed string sequence plus the kept side
    lengths ``len_a``/``len_b`` and the task's ``max_length``.  Rows that carry them are returned as they are."""
    if "seq" in rows.columns:
        return rows
    t = token_table(rows)
    seq, la, lb, ml = {}, {}, {}, {}
    for spec in tasks:
        if spec.kind == "single":
            kept = F.slice(F.col("tokens_a"), 1, spec.max_length - 2)
            seq[spec.name] = tx.single_sequence("tokens_a", spec.max_length)
            la[spec.name] = F.size(kept)
            lb[spec.name] = F.lit(0)
        else:
            a2, b2 = tx.trim_pair("tokens_a", F.coalesce("tokens_b", F.array().cast("array<string>")),
                                  spec.max_length, spec.max_a, spec.max_b)
            seq[spec.name] = tx.pair_sequence(a2, b2)
            la[spec.name] = F.size(a2)
            lb[spec.name] = F.size(b2)
        ml[spec.name] = F.lit(spec.max_length)
    pair_tasks = [s.name for s in tasks if s.kind == "pair"]
    return t.select(
        "*", _by_task(seq).alias("seq"), _by_task(la).alias("len_a"), _by_task(lb).alias("len_b"),
        _by_task(ml).alias("max_length"), F.col("task").isin(pair_tasks).alias("is_pair"),
    ).drop("tokens_a", "tokens_b")


def encode(rows: DataFrame, vocab: DataFrame, keys=("task", "split", "id"), carry=("label_idx",),
           tasks=TASKS) -> DataFrame:
    """``input_ids``, ``attention_mask``, ``token_type_ids``
    (ARRAY<INT>, length = task max_length) for every row.

    The trimmed sequences are dealt out by key, one row per document; the
    columns that go with a document ride on its first token only.
    """
    keys, carry = list(keys), [c for c in carry if c in rows.columns]
    fixed = [*carry, "len_a", "len_b", "max_length", "is_pair"]
    s = sequences(rows, tasks).select(*keys, *fixed, "seq").repartition(*keys)
    first = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in fixed]
    long = s.select(*keys, *fixed, F.posexplode("seq").alias("pos", "token")).select(*keys, "pos", "token", *first)
    g = _with_ids(long, vocab.select("token", "token_id"), keys, fixed,
                  rows.filter(" OR ".join(f"{k} IS NULL" for k in keys)).isEmpty())
    ids = F.transform("_s", lambda x: x["tid"])
    n_real = F.size("_s")
    L = F.col("max_length")
    return g.select(
        *keys, *carry, "len_a", "len_b", "max_length",
        tx.pad_ids(ids, L).alias("input_ids"),
        tx.attention_mask(n_real, L).alias("attention_mask"),
        tx.segment_ids(F.col("len_a"), F.col("len_b"), L, F.col("is_pair")).alias("token_type_ids"),
    )


def _with_ids(long: DataFrame, vocab: DataFrame, keys: list[str], fixed: list[str], whole_keys: bool) -> DataFrame:
    """Tokens (``keys``, ``pos``, ``token``) looked up and put together again: ``_s``, the row's ids in order.  The commonest
    tokens (the smallest ids) are broadcast, so a row's tokens stay where they are; only those of the rest of a large
    vocabulary travel to it and back."""
    pair = lambda tid: F.struct("pos", F.coalesce(tid, F.lit(UNK_ID)).alias("tid"))
    gathered = lambda rows, *more: rows.groupBy(*keys).agg(F.collect_list(pair(F.col("token_id"))).alias("_s"), *more)
    extra = [F.max(c).alias(c) for c in fixed]
    if (vocab.agg(F.max("token_id")).first()[0] or 0) < HOT_IDS:
        g = gathered(long.join(checked_broadcast(vocab), "token", "left"), *extra)
        return g.withColumn("_s", F.array_sort("_s"))
    common = long.join(checked_broadcast(vocab.filter(F.col("token_id") < HOT_IDS)), "token", "left")
    known = common.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("token_id").isNotNull(), F.struct("pos", F.col("token_id").alias("tid")))).alias("_s"), *extra)
    rare = common.filter(F.col("token_id").isNull()).select(*keys, "pos", "token")
    rare = gathered(rare.join(vocab.filter(F.col("token_id") >= HOT_IDS), "token", "left")).withColumnRenamed("_s", "_r")
    if whole_keys:  # a plain join finds the rows where they are
        both = known.join(rare, keys, "left")
    else:
        other = rare.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_r")
        both = known.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    whole = F.concat("_s", F.coalesce("_r", F.array().cast("array<struct<pos:int,tid:int>>")))
    return both.select(*keys, *fixed, F.array_sort(whole).alias("_s"))


def check_lengths(features: DataFrame) -> DataFrame:
    """Per (task, split) rows whose arrays are not exactly max_length, and
    rows whose mask sum differs from the real token count."""
    bad = lambda c: F.sum(F.when(F.size(c) != F.col("max_length"), 1).otherwise(0))
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    pair_tasks = [t.name for t in TASKS if t.kind == "pair"]
    expect = F.col("len_a") + F.col("len_b") + F.when(F.col("task").isin(pair_tasks), 3).otherwise(2)
    return (features.groupBy("task", "split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        bad("input_ids").cast("bigint").alias("bad_ids"),
        bad("attention_mask").cast("bigint").alias("bad_mask"),
        bad("token_type_ids").cast("bigint").alias("bad_segments"),
        F.sum(real).cast("bigint").alias("real_tokens"),
        F.sum(F.when(real != expect, 1).otherwise(0)).cast("bigint").alias("bad_real")))
