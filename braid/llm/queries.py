"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, divergence, fingerprints, html_text, langid, manifest, mixing, ngram_join, packing, quality, repeats, secret_scan, topk
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]

# The conversation added to the table: both turns hold the template's own control strings.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    nodes = chat.conversation_nodes(turns.unionByName(added))
    chats = chat.format_paths(chat.rank_branches(chat.reply_paths(nodes), best=1))
    text, turn = F.col("formatted"), chat.read_turns(F.col("formatted"))
    back = chats.select("tree_id", "formatted", turn.alias("turns"),
                        chat.loss_text(text, F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length(text).cast("long").alias("formatted_chars"))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn,
         length(role) + length(text) + 14
         + length(regexp_replace(role || text, '[^\\\\<#:]', '', 'g')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(read_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.ngram_join(read_table(spark, sf_dir, "documents"), words=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w
), s AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
       AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM g UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a
)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, min(r.reach) AS component_id
FROM g JOIN r ON g.doc_id = r.doc_id GROUP BY g.doc_id, g.g
"""


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantise(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.filter(F.col("id") % 100 == 0), k=10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS s, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix-1') AS key
  FROM documents
), src AS (
  SELECT s, source, sum(size) AS source_size FROM d GROUP BY s, source
), w AS (
  SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM src
), lv AS (
  SELECT *, row_number() OVER o AS rk,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
            ORDER BY source_size * 3 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size * 3 / weight, source IS NULL, source
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w WINDOW o AS (ORDER BY source_size * 3 / weight, source IS NULL, source)
), t AS (
  SELECT s, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN lvl * weight >= source_size * 3 THEN CAST(source_size * 3 AS DOUBLE)
              ELSE weight * (SELECT arg_min(lvl, rk) FROM lv WHERE lvl * weight < source_size * 3) END AS target
  FROM lv
), q AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.s ORDER BY key, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
  FROM d JOIN t ON d.s = t.s
), p AS (
  SELECT row, size, sum(size) OVER (ORDER BY CAST(done + k * source_size AS DOUBLE) / target, s, row, k
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM q, range(3) AS r(k) WHERE size > 0
), g AS (
  SELECT row, count(*) AS n FROM p WHERE run <= (SELECT sum(size) FROM d) GROUP BY row
)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g ON q.row = g.row
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.tokenise(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, docs.count())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeated_spans(read_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    rows = html_text.extract(pages, html_text.fit(pages))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cnt AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), gn AS (
  SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0)::HUGEINT AS total
  FROM g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL) USING (lang, source)
), p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM gn JOIN kept ON gn.lang = kept.lang LEFT JOIN cnt ON cnt.lang = gn.lang AND cnt.source = gn.source AND cnt.term = kept.term
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(t) + 2 * any_value(v)) AS q
  FROM cnt JOIN (SELECT lang, sum(total) AS t, any_value(v) AS v FROM gn GROUP BY lang) USING (lang) GROUP BY lang, term
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM gn a JOIN gn b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.filter(~held_out), read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(read_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, concat(
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         text, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 3 END AS kept
  FROM documents, tab
), leaf AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS node,
         CASE WHEN kept = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM d
), l0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM leaf
), nodes(step, tree, pos, node) AS (
  SELECT 0, tree, pos, node FROM l0
  UNION ALL
  SELECT step + 1, tree, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY step, tree, pos // 8
), tops AS (
  SELECT tree, max(step) AS steps, arg_max(node, step) AS subroot FROM nodes GROUP BY tree
), f0 AS (
  SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tops
), over(step, pos, node) AS (
  SELECT 0, pos, subroot FROM f0
  UNION ALL
  SELECT step + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM over) WHERE n > 1 GROUP BY step, pos // 8
), top AS (
  SELECT max(step) AS steps, arg_max(node, step) AS root FROM over
), below AS (
  SELECT a.tree, a.step, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.step = b.step AND a.pos // 8 = b.pos // 8
  GROUP BY a.tree, a.step, a.pos
), above AS (
  SELECT a.step, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM over a JOIN over b ON a.step = b.step AND a.pos // 8 = b.pos // 8 GROUP BY a.step, a.pos
), path AS (
  SELECT l0.tree, l0.pos, b.step AS k, b.l, b.r FROM l0 JOIN tops USING (tree)
  JOIN below b ON b.tree = l0.tree AND b.step < tops.steps AND b.pos = l0.pos // (8 ** b.step)::BIGINT
  UNION ALL
  SELECT l0.tree, l0.pos, 1000 + a.step, a.l, a.r FROM l0 JOIN f0 USING (tree)
  JOIN above a ON a.step < (SELECT steps FROM top) AND a.pos = f0.pos // (8 ** a.step)::BIGINT
), steps AS (
  SELECT tree, pos, list({'l': l, 'r': r} ORDER BY k) AS p FROM path GROUP BY tree, pos
), folded(tree, pos, i, node) AS (
  SELECT tree, pos, 1, coalesce(other, node) FROM l0
  UNION ALL
  SELECT f.tree, f.pos, i + 1, sha256(p[i].l || f.node || p[i].r)
  FROM folded f JOIN steps s ON f.tree = s.tree AND f.pos = s.pos WHERE i <= len(p)
), last AS (
  SELECT tree, pos, arg_max(node, i) AS folded_root FROM folded GROUP BY tree, pos
)
SELECT l0.doc_id, l0.node AS leaf, subroot, root,
       sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM l0 JOIN tops USING (tree) CROSS JOIN top JOIN last ON last.tree = l0.tree AND last.pos = l0.pos
LEFT JOIN steps s ON s.tree = l0.tree AND s.pos = l0.pos
"""


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_fingerprints": op2_fingerprints,
        "op3_ngram_join": op3_ngram_join,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_secret_scan": op5_secret_scan,
        "op6_mix_sources": op6_mix_sources,
        "op7_packing": op7_packing,
        "op8_language_id": op8_language_id,
        "op9_repeat_removal": op9_repeat_removal,
        "op10_html_text": op10_html_text,
        "op11_source_divergence": op11_source_divergence,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op3_ngram_join": OP3_SQL,
        "op4_exact_top_k": OP4_SQL,
        "op6_mix_sources": OP6_SQL,
        "op11_source_divergence": OP11_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
