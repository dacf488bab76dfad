"""Exact Jaccard self-join of word n-gram sets by a grouped prefix join.

1. *Shared n-grams.*  Two sets with Jaccard t or more share at least t of the
   larger one, so a document less than t of whose n-grams occur in another
   document has no partner.  The shards ask the n-gram hash buckets which of
   their n-grams are shared (see ``shards``); all documents take part.
2. *Equal sets* among the rest become one representative.
3. *Prefixes.*  The n-grams of a representative are ordered from rare to
   frequent; partners share one of the first n - ceil(t n) + 1.  N-grams found
   nowhere else come first and open no list.
4. *Groups.*  Representatives with identical prefixes and size form a group;
   prefix lists hold groups.
5. *Group pairs* pass the size and position filters, are expanded to members
   and verified on the whole sets.  In each list a pivot is first compared with
   the members outside its component, for a few rounds.  Then what is not
   connected yet is verified: all such pairs of a short list, and for long lists
   (large groups of near copies) all such pairs of the documents that the lists
   join, block against block, where a task counts common n-grams through a
   local index and returns only links that connect something.  So no link
   between components is missed: what is never compared is connected already.

N-grams are 64-bit hashes.  Defined results.  Null or blank text: an empty set,
linked with nothing.  Fewer words than n: the whole sequence is one n-gram.
Repeated rows (equal id, text or both) are documents of their own with equal
sets, hence linked.  A null id stays null; the component id is the smallest
id that is not null.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, small_side, stored
from .shards import LEAST_BUCKETS, ask, bucket_runs, each_shard, pack, placed, squeeze, unsqueeze, with_answers
from .textkernel import distinct_sorted, shingles

# Rounds of pivot comparisons before the rest of the pairs is verified.
PIVOT_ROUNDS = 2
# Pairs (two longs each) that may be broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
# Longer lists are handled in blocks of so many documents.
SHORT_LIST = 64
BLOCK = 512


def _sets(shard, words: int):
    """(hashes, first index) of the n-gram sets of all texts of a shard."""
    hs, at, base = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, offs in shard.parts():
        h, a = distinct_sorted(*shingles(buf, offs, words))
        hs.append(h)
        at.append(a[1:] + base)
        base += len(h)
    return np.concatenate(hs) if hs else np.empty(0, np.uint64), np.concatenate(at)


def _shared_ngrams(shards: DataFrame, words: int) -> DataFrame:
    """Shards with the answer for each of their distinct n-grams: shared or not."""
    buckets = max(LEAST_BUCKETS, shards.count())

    def question(shard, _):
        h, _ = _sets(shard, words)
        u, count = np.unique(h, return_counts=True)
        here, edge = bucket_runs(u, buckets)
        out = [(b, shard.number, int(hi - lo), squeeze(u[lo:hi] >> np.uint64(32)),
                np.packbits(count[lo:hi] > 1).tobytes())
               for b, lo, hi in zip(here.tolist(), edge[:-1], edge[1:], strict=True)]
        if out:
            yield pd.DataFrame(out, columns=["bucket", "shard", "n", "keys", "many"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(np.int64)
        keys = np.concatenate([unsqueeze(k, m) for k, m in zip(rows["keys"], n, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m)
                               for x, m in zip(rows["many"], n, strict=True)])
        u, inverse = np.unique(keys, return_inverse=True)
        shared = np.bincount(inverse, weights=1 + many, minlength=len(u))[inverse] > 1
        parts = np.split(shared, np.cumsum(n)[:-1])
        return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"],
                             "answer": [np.packbits(p).tobytes() for p in parts]})

    asked = ask(shards, question, "bucket long, shard long, n long, keys binary, many binary")
    return with_answers(shards, asked.groupBy("bucket").applyInPandas(
        answer, "shard long, bucket long, answer binary"))


def _ngram_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``rid``, ``doc_id``, ``n``, ``digest`` of every document; ``grams`` and ``sig`` of those that may have a partner."""
    shards = pack(docs)
    buckets = max(LEAST_BUCKETS, shards.count())

    def keep(shard, row):
        h, at = _sets(shard, words)
        u, inverse = np.unique(h, return_inverse=True)
        shared = placed(u, buckets, row.answers)
        total = np.concatenate([[0], np.cumsum(shared[inverse])])
        n, s = np.diff(at), total[at[1:]] - total[at[:-1]]
        may = (n > 0) & (100 * s >= percent * n)
        grams = [h[at[i]:at[i + 1]].view(np.int64) if may[i] else None for i in range(len(n))]
        ids = pd.array(np.where(shard.null, 0, shard.ids), dtype="Int64")
        ids[shard.null] = pd.NA
        yield pd.DataFrame({
            "rid": shard.rids, "doc_id": ids, "n": n.astype(np.int64), "grams": grams,
            "sig": [None if g is None else hashlib.md5(g.tobytes()).hexdigest() for g in grams],
            "digest": [hashlib.md5(shard.buf[a:b]).hexdigest() for a, b in zip(shard.offs[:-1], shard.offs[1:], strict=True)]})

    return stored(_shared_ngrams(shards, words).mapInPandas(
        each_shard(keep, ""), "rid long, doc_id long, n long, grams array<long>, sig string, digest string"))


def _need(a: Column, percent: int) -> Column:
    """ceil(percent * a / 100)"""
    return F.floor((a * percent + 99) / 100)


def _prefixes(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Prefix postings (``gid``, ``n``, ``gram``, ``pos``) of groups, and their
    members (``gid``, ``rid``).  ``sets``: ``rid``, ``n``, ``grams``."""
    grams = sets.select("rid", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = (grams.join(often, "gram").groupBy("rid")
             .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("shared")))
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - _need(F.col("n"), percent) + 1 - alone
    pre = stored(known.join(sets.select("rid", "n"), "rid").withColumn("alone", alone).filter(length > 0)
                 .select("rid", "n", "alone", F.slice("shared", F.lit(1), length.cast("int"))["gram"].alias("prefix")))
    w = Window.partitionBy("n", "alone", "sig")
    groups = stored(pre.withColumn("sig", F.md5(F.array_join(F.col("prefix").cast("array<string>"), ",")))
                    .select("rid", "n", "alone", "prefix", F.min("rid").over(w).alias("gid")))
    posts = (groups.filter("rid = gid").select("gid", "n", "alone", F.posexplode("prefix").alias("i", "gram"))
             .select("gid", "n", "gram", (F.col("i") + F.col("alone") + 1).alias("pos")))
    return stored(posts), groups.select("gid", "rid")


def _may_link(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Size filter, and position filter for the first n-gram two prefixes have in common."""
    overlap = F.floor(((n1 + n2) * percent + 99 + percent) / (100 + percent))
    return ((n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)
            & (F.least(n1 - p1, n2 - p2) + 1 >= overlap))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a`` < ``b``, distinct and stored) that link."""
    side = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    one = lambda k: sets.select(F.col("rid").alias(k), F.col("n").alias(f"n_{k}"),
                                F.col("grams").alias(f"g_{k}")).join(side, k)
    both = F.size(F.array_intersect("g_a", "g_b"))
    return (one("a").join(one("b"), ["a", "b"])
            .filter(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b"))


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _links(posts: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (``a``, ``b``) that connect all that links connect."""
    # Members of a group: all with the first.
    tried = members.filter("rid <> gid").select(*_ordered("gid", "rid")).distinct()
    tried = stored(tried)
    links = stored(_verify(tried, sets, percent))
    lists = stored(posts.join(members, "gid").select("gram", "gid", "rid", "n", "pos"))
    comp = None
    for turn in range(PIVOT_ROUNDS):
        comp = components(links)
        now = lists.join(comp.select(F.col("v").alias("rid"), "label"), "rid", "left").withColumn(
            "comp", F.coalesce("label", "rid")).drop("label")
        order = F.struct((F.xxhash64("rid", F.lit(turn)) if turn else F.col("rid")).alias("o"), "rid", "n", "pos", "comp")
        pivots = (now.groupBy("gram").agg(F.min(order).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                  .filter("lo <> hi").select("gram", F.col("p.rid").alias("rid2"), F.col("p.n").alias("n2"),
                                             F.col("p.pos").alias("pos2"), F.col("p.comp").alias("comp2")))
        pairs = (now.join(pivots, "gram").filter("comp <> comp2")
                 .filter(_may_link(percent, *map(F.col, ("n", "pos", "n2", "pos2")))).select(*_ordered("rid", "rid2")).distinct().join(tried, ["a", "b"], "left_anti"))
        pairs = stored(pairs)
        if pairs.isEmpty():
            break
        found = stored(_verify(pairs, sets, percent))
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if found.isEmpty():
            break
    # What is left: pairs of one list from two components.
    comp = components(links)
    now = lists.join(comp.select(F.col("v").alias("rid"), "label"), "rid", "left").withColumn(
        "comp", F.coalesce("label", "rid")).drop("label")
    mixed = (now.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo <> hi").select("gram", "c"))
    now = stored(now.join(mixed, "gram"))
    short = (now.filter(F.col("c") <= SHORT_LIST).groupBy("gram")
             .agg(F.collect_list(F.struct("rid", "n", "pos", "comp")).alias("m")))
    found = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (
        (x["rid"] < y["rid"]) & (x["comp"] != y["comp"])
        & _may_link(percent, x["n"], x["pos"], y["n"], y["pos"]))),
        lambda y: F.struct(x["rid"].alias("a"), y["rid"].alias("b")))))
    pairs = stored(short.select(F.explode(found).alias("p")).select("p.*").distinct()
                   .join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(_verify(pairs, sets, percent))
    long = now.filter(F.col("c") > SHORT_LIST).select("gram", "rid", "comp")
    return links if long.isEmpty() else links.unionByName(_block_links(long, sets, percent))


def _block_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect components (``comp``) among the documents of long
    ``lists`` (``gram``, ``rid``, ``comp``): documents that lists join are a cluster, dealt into
    blocks, and every two blocks of a cluster meet in one task."""
    first = lists.groupBy("gram").agg(F.min("rid").alias("b"))
    cluster = components(lists.join(first, "gram").select(F.col("rid").alias("a"), "b"))
    docs = lists.select("rid", "comp").distinct().join(cluster.withColumnRenamed("v", "rid"), "rid")
    sizes = docs.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    docs = docs.join(sizes, "label").withColumn("blocks", F.floor((F.col("m") - 1) / BLOCK) + 1)
    docs = docs.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    met = docs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("rid", "comp", "label", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid", ignore_index=True)
        root = {c: c for c in rows["comp"]}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c
        n = rows["grams"].map(len).to_numpy()
        at = np.concatenate([[0], np.cumsum(n)])
        grams, inverse, count = np.unique(np.concatenate(rows["grams"].to_numpy()), return_inverse=True,
                                          return_counts=True)
        owner = np.repeat(np.arange(len(n)), n)[np.argsort(inverse, kind="stable")]
        ends = np.cumsum(count)
        rid, comp, out = rows["rid"].to_numpy(), rows["comp"].to_numpy(), []
        for i in range(len(n)):
            # How many n-grams each document has in common with this one.
            own = inverse[at[i]:at[i + 1]]
            c = count[own]
            holders = owner[np.repeat(ends[own] - np.cumsum(c), c) + np.arange(c.sum())]
            both = np.bincount(holders, minlength=len(n))
            for j in np.flatnonzero(both * 100 >= (n + n[i] - both) * percent):
                if j > i and find(comp[i]) != find(comp[j]):
                    root[find(comp[i])] = find(comp[j])
                    out.append((rid[i], rid[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return (met.join(sets.select("rid", "grams"), "rid").groupBy("label", "x", "y")
            .applyInPandas(verify, "a long, b long"))


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document of ``docs`` (``doc_id``, ``text``): ``doc_id``,
    ``n_shingles`` (set size), ``component_id`` (smallest id it reaches by
    links), ``component`` (a number of the component, also where ids are null
    or repeated) and ``digest`` (MD5 of the text).  Two documents link when
    100 * intersection >= percent * union of their sets of ``words``-grams."""
    rows = _ngram_sets(docs, words, percent)
    may = rows.filter("sig IS NOT NULL")
    reps = stored(may.groupBy("sig", "n").agg(F.min("rid").alias("rep")))
    ids = stored(reps.select(F.col("rep").alias("rid")))
    sets = may.join(small_side(ids), "rid", "left_semi").select("rid", "n", "grams")
    posts, members = _prefixes(sets, percent)
    sets = stored(sets.join(small_side(stored(members.select("rid"))), "rid", "left_semi"))
    comp = components(_links(posts, members, sets, percent))
    of = (may.select("rid", "doc_id", "sig", "n").join(reps, ["sig", "n"])
          .join(comp.select(F.col("v").alias("rep"), "label"), "rep", "left")
          .select("rid", "doc_id", F.coalesce("label", "rep").alias("label")))
    of = stored(of)
    least = stored(of.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    # Broadcast while small, so the members of a large component need not meet.
    comp_of = of.select("rid", "label").join(small_side(least), "label").select("rid", "label", "component_id")
    return (rows.select("rid", "doc_id", "n", "digest").join(comp_of, "rid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("label", "rid").alias("component"), "digest"))
