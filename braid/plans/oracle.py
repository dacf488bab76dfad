"""Independent DuckDB SQL for every registered query.

Written from the operator definitions with plain windows (no bucketing), so
the Spark plans are checked against a different formulation.  Tables are the
driver's pre-registered views.  CTE fragments are composed in Python.
"""

from __future__ import annotations

# --- shared CTE fragments ---------------------------------------------------

EX = """
ex AS (
  SELECT 'quality' AS task, d.doc_id::BIGINT AS id, d.text AS text_a, NULL::VARCHAR AS text_b,
         'q' || l.quality::VARCHAR || 't' || l.toxic::VARCHAR AS label, 'labelled' AS kind
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'quality', d.doc_id, d.text, NULL, NULL, 'test' FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  UNION ALL
  SELECT 'turns', a.conv_id * 16777216 + a.turn, a.text, b.text, a.role || '>' || b.role, 'labelled'
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  UNION ALL
  SELECT 'turns', a.conv_id * 16777216 + a.turn, a.text, b.text, NULL, 'test'
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
  UNION ALL
  SELECT 'lang', doc_id, text, NULL, lang, 'labelled' FROM documents
  UNION ALL
  SELECT 'lang', item_id, text, NULL, NULL, 'test' FROM benchmark
),
lab AS (SELECT * FROM ex WHERE kind = 'labelled' AND label IS NOT NULL),
td AS (SELECT * FROM (VALUES ('quality', 0, 'single', 170, 0, 0), ('turns', 1, 'pair', 100, 50, 30),
                             ('lang', 2, 'single', 60, 0, 0))
       t(task, task_idx, kind, max_length, max_a, max_b)),
ldim AS (SELECT task, label, (row_number() OVER (PARTITION BY task ORDER BY label) - 1)::INT AS label_idx
         FROM (SELECT DISTINCT task, label FROM lab))
"""

PLAN = """
tc AS (SELECT task, count(*)::BIGINT AS n FROM lab GROUP BY task),
p1 AS (SELECT tc.task, td.task_idx, tc.n,
              round_even(72.0 * (tc.n::DOUBLE / sum(tc.n) OVER ()), 0)::BIGINT AS b
       FROM tc JOIN td ON tc.task = td.task),
p2 AS (SELECT *, n // b AS nb FROM p1),
mn AS (SELECT n AS min_n, b AS min_b, nb AS min_nb FROM p2 ORDER BY nb, task_idx LIMIT 1),
plan AS (SELECT p2.task, p2.task_idx, p2.n, p2.b AS batch_size, p2.nb AS n_batches,
                (mn.min_nb - floor(mn.min_n * 0.1::DOUBLE)::BIGINT // mn.min_b) AS train_batches
         FROM p2, mn),
plan2 AS (SELECT *, n - train_batches * batch_size AS dev_n FROM plan)
"""

QUOTA = """
lc AS (SELECT task, label, count(*)::BIGINT AS n FROM lab GROUP BY task, label),
q0 AS (SELECT lc.task, lc.label, lc.n, p.n AS task_n, p.dev_n,
              floor(lc.n * (p.dev_n::DOUBLE / p.n))::BIGINT AS quota0
       FROM lc JOIN plan2 p ON lc.task = p.task),
q1 AS (SELECT *, n - quota0 AS spare, dev_n - sum(quota0) OVER (PARTITION BY task) AS leftover FROM q0),
q2 AS (SELECT *, coalesce(sum(spare) OVER (PARTITION BY task ORDER BY md5(label || '|2020'), label
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare_before
       FROM q1),
quota AS (SELECT task, label, n, (quota0 + least(spare, greatest(0, leftover - spare_before)))::BIGINT AS quota
          FROM q2)
"""

SPLITS = """
rk AS (SELECT l.*, row_number() OVER (PARTITION BY task, label ORDER BY md5(id::VARCHAR || '|2020'), id) AS rn
       FROM lab l),
splits AS (
  SELECT rk.task, rk.id, rk.text_a, rk.text_b, rk.label,
         CASE WHEN rk.rn <= q.quota THEN 'dev' ELSE 'train' END AS split
  FROM rk JOIN quota q ON rk.task = q.task AND rk.label = q.label
  UNION ALL
  SELECT task, id, text_a, text_b, label, 'test' FROM ex WHERE kind = 'test'
)
"""

CW = """
cw AS (SELECT task, label, n, ln(sum(n) OVER (PARTITION BY task) / n) AS weight,
              row_number() OVER (PARTITION BY task ORDER BY n DESC, label)::INT AS freq_rank FROM lc)
"""


def with_(*parts: str) -> str:
    return ("WITH RECURSIVE " if STEPS in parts else "WITH ") + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


PREP = (EX, PLAN, QUOTA, SPLITS)


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["split_summary"] = with_(*PREP, CW) + """
SELECT s.task, s.split, s.label, count(*)::BIGINT AS n, round(any_value(cw.weight), 6) AS class_weight
FROM splits s LEFT JOIN cw ON s.task = cw.task AND s.label = cw.label
GROUP BY s.task, s.split, s.label"""
    return q


def _step1(q: dict[str, str]) -> None:
    q["examples"] = with_(EX) + "SELECT task, id, text_a, text_b, label, kind FROM ex"
    q["debug_head"] = with_(*PREP) + """
SELECT task, split, id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY task, split ORDER BY id) AS rn FROM splits) WHERE rn <= 40"""
    q["label_dim"] = with_(EX) + "SELECT task, label, label_idx FROM ldim"
    q["encoded_labels"] = with_(EX) + """
SELECT e.task, e.kind, e.id, e.label, d.label_idx FROM ex e LEFT JOIN ldim d ON e.task = d.task AND e.label = d.label"""
    q["split_counts"] = with_(*PREP) + """
SELECT task, split, count(*)::BIGINT AS n, (CASE WHEN task IS NULL THEN 2 ELSE 0 END + CASE WHEN split IS NULL THEN 1 ELSE 0 END)::INT AS level
FROM splits GROUP BY CUBE (task, split)"""
    q["label_counts"] = with_(EX) + "SELECT task, label, count(*)::BIGINT AS n FROM lab GROUP BY task, label"
    q["class_weights"] = with_(EX, "lc AS (SELECT task, label, count(*)::BIGINT AS n FROM lab GROUP BY task, label)", CW) + \
        "SELECT task, label, n, round(weight, 6) AS weight, freq_rank FROM cw"
    q["task_proportions"] = with_(EX) + """
SELECT task, n, round(n::DOUBLE / sum(n) OVER (), 6) AS p FROM (SELECT task, count(*)::BIGINT AS n FROM lab GROUP BY task)"""


def _step2(q: dict[str, str]) -> None:
    q["split_plan"] = with_(EX, PLAN) + """
SELECT task, task_idx::BIGINT AS task_idx, n, batch_size, n_batches, train_batches, dev_n,
       round(dev_n::DOUBLE / n, 6) AS dev_fraction FROM plan2"""
    q["label_quota"] = with_(EX, PLAN, QUOTA) + "SELECT task, label, n, quota FROM quota"
    q["stratified_split"] = with_(*PREP) + "SELECT task, id, label, split FROM splits"
    q["anti_split"] = with_(*PREP) + "SELECT task, id, label FROM splits WHERE split = 'train'"
    q["split_check"] = with_(*PREP) + """
SELECT l.task, l.n_labelled, s.n_train, s.n_dev, 0::BIGINT AS n_overlap
FROM (SELECT task, count(*)::BIGINT AS n_labelled FROM lab GROUP BY task) l
JOIN (SELECT task, count(*) FILTER (WHERE split = 'train')::BIGINT AS n_train,
             count(*) FILTER (WHERE split = 'dev')::BIGINT AS n_dev FROM splits WHERE split <> 'test' GROUP BY task) s
  ON l.task = s.task"""
    q["dev_split"] = with_(*PREP) + """
SELECT s.task, s.id, s.label, d.label_idx FROM splits s LEFT JOIN ldim d ON s.task = d.task AND s.label = d.label
WHERE s.split = 'dev'"""


BATCHES = """
pos AS (
  SELECT s.task, s.split, s.id,
         row_number() OVER (PARTITION BY s.task, s.split
                            ORDER BY CASE WHEN s.split = 'test' THEN NULL ELSE md5(s.id::VARCHAR || '|2020|' || {epoch}) END,
                                     s.id)::BIGINT AS pos
  FROM splits s),
bat AS (SELECT pos.*, (pos.pos - 1) // p.batch_size AS batch_id FROM pos JOIN plan2 p ON pos.task = p.task)
"""


def _step3(q: dict[str, str]) -> None:
    q["batches"] = with_(*PREP, BATCHES.format(epoch=1)) + "SELECT task, split, id, pos, batch_id FROM bat"
    q["lockstep"] = with_(*PREP, BATCHES.format(epoch=2)) + """
SELECT (batch_id + 1)::BIGINT AS step, task, count(*)::BIGINT AS n_rows, sum(id)::BIGINT AS id_sum
FROM bat WHERE split = 'train'
  AND batch_id IN (SELECT batch_id FROM bat WHERE split = 'train' GROUP BY batch_id HAVING count(DISTINCT task) = 3)
GROUP BY batch_id, task"""
    q["submission_positions"] = with_(EX) + """
SELECT task, id, (row_number() OVER (PARTITION BY task ORDER BY id) - 1)::BIGINT AS position FROM ex WHERE kind = 'test'"""


from ..config import TOKEN_PATTERN  # noqa: E402

TOK = f"""
tok AS (SELECT s.*, regexp_extract_all(lower(s.text_a), '{TOKEN_PATTERN}', 0) AS ta,
               CASE WHEN s.text_b IS NULL THEN NULL
                    ELSE regexp_extract_all(lower(s.text_b), '{TOKEN_PATTERN}', 0) END AS tb
        FROM splits s),
vc AS (SELECT t AS token, count(*)::BIGINT AS n
       FROM (SELECT unnest(list_concat(ta, coalesce(tb, []::VARCHAR[]))) AS t FROM tok WHERE split = 'train')
       GROUP BY t),
vocab AS (SELECT * FROM (VALUES ('[PAD]', 0::BIGINT, 0::BIGINT), ('[UNK]', 0, 1), ('[CLS]', 0, 2), ('[SEP]', 0, 3))
                 v(token, n, token_id)
          UNION ALL
          SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 3)::BIGINT FROM vc)
"""

# head(L) + tail(L) of list x with length n (x longer than L)
def _ht(x: str, n: str, lim: str) -> str:
    return (f"CASE WHEN {n} <= {lim} THEN {x} ELSE list_concat(list_slice({x}, 1, ({lim}) // 2), "
            f"list_slice({x}, {n} - (({lim}) - ({lim}) // 2) + 1, {n})) END")


def _trim(max_len: int, max_a: int, max_b: int) -> str:
    m = max_len - 3
    return f"""
tr0 AS (SELECT *, len(ta) AS la, len(coalesce(tb, []::VARCHAR[])) AS lb, coalesce(tb, []::VARCHAR[]) AS tb0
        FROM tok WHERE task = 'turns'),
tr AS (SELECT *,
  CASE WHEN la + lb + 3 <= {max_len} THEN ta
       WHEN lb >= {max_b} AND la >= {max_a} THEN {_ht('ta', 'la', str(max_a))}
       WHEN la <= lb AND la < {max_a} THEN ta
       WHEN lb < la AND lb <= {max_b} THEN {_ht('ta', 'la', f'{max_a} + ({max_b} - lb - 1)')}
       ELSE list_slice(ta, 1, least(la, greatest(ceil({m} / 2)::INT, {m} - lb))) END AS ka,
  CASE WHEN la + lb + 3 <= {max_len} THEN tb0
       WHEN lb >= {max_b} AND la >= {max_a} THEN {_ht('tb0', 'lb', str(max_b))}
       WHEN la <= lb AND la < {max_a} THEN {_ht('tb0', 'lb', f'{max_b} + ({max_a} - la - 1)')}
       WHEN lb < la AND lb <= {max_b} THEN tb0
       ELSE list_slice(tb0, 1, least(lb, greatest(floor({m} / 2)::INT, {m} - la))) END AS kb
  FROM tr0)
"""


TRIM = _trim(100, 50, 30)

SEQ = """
sq AS (
  SELECT task, split, id, label, ['[CLS]'] || list_slice(ta, 1, 168) || ['[SEP]'] AS seq,
         len(list_slice(ta, 1, 168)) AS la, 0 AS lb, 170 AS ml, false AS pair FROM tok WHERE task = 'quality'
  UNION ALL
  SELECT task, split, id, label, ['[CLS]'] || list_slice(ta, 1, 58) || ['[SEP]'],
         len(list_slice(ta, 1, 58)), 0, 60, false FROM tok WHERE task = 'lang'
  UNION ALL
  SELECT task, split, id, label, ['[CLS]'] || ka || ['[SEP]'] || kb || ['[SEP]'], len(ka), len(kb), 100, true
  FROM tr),
sx AS (SELECT task, split, id, label, la, lb, ml, pair, unnest(seq) AS token, generate_subscripts(seq, 1) AS pos FROM sq),
enc AS (SELECT sx.task, sx.split, sx.id, sx.label, sx.la, sx.lb, sx.ml, sx.pair,
               list(coalesce(v.token_id, 1) ORDER BY sx.pos) AS ids
        FROM sx LEFT JOIN vocab v ON sx.token = v.token
        GROUP BY sx.task, sx.split, sx.id, sx.label, sx.la, sx.lb, sx.ml, sx.pair),
feat AS (SELECT e.task, e.split, e.id, d.label_idx, e.la, e.lb, e.ml,
                list_resize(e.ids, e.ml, 0) AS input_ids,
                list_resize(list_resize([]::BIGINT[], len(e.ids), 1), e.ml, 0) AS attention_mask,
                CASE WHEN e.pair THEN list_concat(list_resize([]::BIGINT[], e.la + 2, 0),
                                                  list_resize([]::BIGINT[], e.lb + 1, 1),
                                                  list_resize([]::BIGINT[], e.ml - e.la - e.lb - 3, 0))
                     ELSE list_resize([]::BIGINT[], e.ml, 0) END AS token_type_ids
         FROM enc e LEFT JOIN ldim d ON e.task = d.task AND e.label = d.label)
"""


def _step4(q: dict[str, str]) -> None:
    q["tokens"] = with_(EX) + f"""
SELECT task, kind, id, len(regexp_extract_all(lower(text_a), '{TOKEN_PATTERN}', 0))::BIGINT AS n_a,
       CASE WHEN text_b IS NULL THEN NULL ELSE len(regexp_extract_all(lower(text_b), '{TOKEN_PATTERN}', 0)) END::BIGINT AS n_b,
       array_to_string(regexp_extract_all(lower(text_a), '{TOKEN_PATTERN}', 0), ' ') AS tokens_a
FROM ex"""
    q["vocab"] = with_(*PREP, TOK) + "SELECT token, n, token_id FROM vocab"
    q["pair_trim"] = with_(EX, f"""
splits AS (SELECT task, id, text_a, text_b, kind AS split FROM ex WHERE task = 'turns')""",
                           TOK.split("vc AS")[0], TRIM) + """
SELECT split AS kind, id, la::BIGINT AS len_a, lb::BIGINT AS len_b,
       array_to_string(ka, ' ') AS kept_a, array_to_string(kb, ' ') AS kept_b FROM tr"""
    q["pair_trim_longest"] = with_(EX, f"""
splits AS (SELECT task, id, text_a, text_b, kind AS split FROM ex WHERE task = 'turns')""",
                                   TOK.split("vc AS")[0], _trim(60, 10, 40)) + """
SELECT split AS kind, id, len(ka)::BIGINT AS n_a, len(kb)::BIGINT AS n_b,
       array_to_string(ka, ' ') AS kept_a, array_to_string(kb, ' ') AS kept_b FROM tr"""
    q["features"] = with_(*PREP, TOK, TRIM, SEQ) + """
SELECT task, split, id, label_idx::BIGINT AS label_idx, array_to_string(input_ids, ' ') AS input_ids,
       array_to_string(attention_mask, ' ') AS attention_mask, array_to_string(token_type_ids, ' ') AS token_type_ids
FROM feat"""
    q["length_check"] = with_(*PREP, TOK, TRIM, SEQ) + """
SELECT task, split, count(*)::BIGINT AS n,
       count(*) FILTER (WHERE len(input_ids) <> ml)::BIGINT AS bad_ids,
       count(*) FILTER (WHERE len(attention_mask) <> ml)::BIGINT AS bad_mask,
       count(*) FILTER (WHERE len(token_type_ids) <> ml)::BIGINT AS bad_segments,
       sum(list_sum(attention_mask))::BIGINT AS real_tokens,
       count(*) FILTER (WHERE list_sum(attention_mask) <> la + lb + CASE WHEN task = 'turns' THEN 3 ELSE 2 END)::BIGINT AS bad_real
FROM feat GROUP BY task, split"""


VX = """
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
      FROM embeddings),
cen AS (SELECT label, dim, avg(v) AS c FROM x GROUP BY label, dim),
bias AS (SELECT label, -0.5 * sum(c * c) AS b FROM cen GROUP BY label),
cls AS (SELECT label, (row_number() OVER (ORDER BY label) - 1) AS k FROM (SELECT DISTINCT label FROM embeddings)),
lin AS (SELECT x.vec_id, cls.k AS class_idx, sum(x.v * cen.c) + any_value(bias.b) AS logit
        FROM x JOIN cen ON x.dim = cen.dim JOIN bias ON cen.label = bias.label JOIN cls ON cen.label = cls.label
        GROUP BY x.vec_id, cls.k),
sx AS (SELECT x.*, x.vec_id // 8 AS seq_id, x.vec_id % 8 AS pos FROM x),
wq AS (SELECT dim, avg(v) AS w FROM x GROUP BY dim),
gate AS (SELECT sx.vec_id, any_value(sx.seq_id) AS seq_id, sum(sx.v * wq.w) AS g FROM sx JOIN wq ON sx.dim = wq.dim
         GROUP BY sx.vec_id),
att AS (SELECT vec_id, seq_id, exp(g - max(g) OVER (PARTITION BY seq_id))
                               / sum(exp(g - max(g) OVER (PARTITION BY seq_id))) OVER (PARTITION BY seq_id) AS a
        FROM gate)
"""

ATT_FIX = """
gate2 AS (SELECT *, max(g) OVER (PARTITION BY seq_id) AS gm FROM gate),
att2 AS (SELECT vec_id, seq_id, exp(g - gm) / sum(exp(g - gm)) OVER (PARTITION BY seq_id) AS a FROM gate2)
"""


def _step5(q: dict[str, str]) -> None:
    q["array_kit"] = """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS argmax,
       round(sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))), 6) AS norm,
       len(list_filter(embedding, lambda e: e <> 0))::BIGINT AS n_nonzero,
       round(1.0 / list_sum(list_transform(embedding, lambda e: exp(e::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS max_softmax,
       round(CASE WHEN list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) > 0
                  THEN embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)))
                  ELSE 0 END, 6) AS unit_x0,
       label::BIGINT AS onehot_pos
FROM embeddings"""
    q["centroids"] = with_(VX) + """
SELECT cen.label::BIGINT AS label, cen.dim::BIGINT AS dim, round(cen.c, 6) AS c, round(bias.b, 6) AS bias
FROM cen JOIN bias ON cen.label = bias.label"""
    q["linear_scores"] = with_(VX) + "SELECT vec_id, class_idx::BIGINT AS class_idx, round(logit, 6) AS logit FROM lin"
    q["linear_scores_join"] = q["linear_scores"]
    q["pool_first"] = with_(VX) + """
SELECT seq_id, dim::BIGINT AS dim, round(v, 6) AS v FROM sx
WHERE (seq_id, pos) IN (SELECT (seq_id, min(pos)) FROM sx GROUP BY seq_id)"""
    q["pool_max"] = with_(VX) + "SELECT seq_id, dim::BIGINT AS dim, round(max(v), 6) AS v FROM sx GROUP BY seq_id, dim"
    q["pool_attention"] = with_(VX, ATT_FIX) + """
SELECT sx.seq_id, sx.dim::BIGINT AS dim, round(greatest(sum(att2.a * sx.v), 0), 6) AS v
FROM sx JOIN att2 ON sx.vec_id = att2.vec_id GROUP BY sx.seq_id, sx.dim"""
    q["layer_mix"] = with_(VX) + """
SELECT seq_id, dim::BIGINT AS dim,
       round(sum(v * CASE WHEN pos = 7 THEN 1.0 ELSE exp(-3.0) END / (7 * exp(-3.0) + 1.0)), 6) AS v
FROM sx GROUP BY seq_id, dim"""
    q["last_k_concat"] = with_(VX) + """
SELECT seq_id, (rk * 64 + dim)::BIGINT AS dim, round(v, 6) AS v FROM (
  SELECT sx.*, dense_rank() OVER (PARTITION BY seq_id ORDER BY pos DESC) - 1 AS rk FROM sx) WHERE rk < 4"""
    q["ensemble_mean"] = with_(VX) + """
SELECT vec_id // 8 AS seq_id, class_idx::BIGINT AS class_idx, round(avg(logit), 6) AS logit
FROM lin GROUP BY vec_id // 8, class_idx"""
    q["mix_heads"] = with_(VX, ATT_FIX) + """
SELECT att2.seq_id, lin.class_idx::BIGINT AS class_idx, round(sum(att2.a * lin.logit), 6) AS logit
FROM lin JOIN att2 ON lin.vec_id = att2.vec_id GROUP BY att2.seq_id, lin.class_idx"""


NB = """
tokl AS (SELECT t.task, t.split, t.id, d.label_idx, list_concat(t.ta, coalesce(t.tb, []::VARCHAR[])) AS toks
         FROM tok t LEFT JOIN ldim d ON t.task = d.task AND t.label = d.label),
cnt AS (SELECT task, split, id, label_idx, token, count(*)::BIGINT AS cnt
        FROM (SELECT task, split, id, label_idx, unnest(toks) AS token FROM tokl) GROUP BY ALL),
trc AS (SELECT * FROM cnt WHERE split = 'train'),
wc AS (SELECT task, label_idx, token, sum(cnt) AS n_wc FROM trc GROUP BY ALL),
nwc AS (SELECT task, label_idx, sum(cnt) AS n_c_tok FROM trc GROUP BY ALL),
vv AS (SELECT task, count(DISTINCT token) AS vsize FROM trc GROUP BY task),
nd AS (SELECT task, label_idx, count(*) AS n_docs FROM tokl WHERE split = 'train' GROUP BY ALL),
ncls AS (SELECT d.task, d.label_idx, coalesce(nwc.n_c_tok, 0) AS n_c_tok, coalesce(nd.n_docs, 0) AS n_docs,
                coalesce(vv.vsize, 0) AS vsize
         FROM ldim d LEFT JOIN nwc ON d.task = nwc.task AND d.label_idx = nwc.label_idx
                     LEFT JOIN nd ON d.task = nd.task AND d.label_idx = nd.label_idx
                     LEFT JOIN vv ON d.task = vv.task),
vt AS (SELECT DISTINCT task, token FROM wc),
ll AS (SELECT vt.task, vt.token, c.label_idx AS k,
              ln((coalesce(wc.n_wc, 0) + 1)::DOUBLE / (c.n_c_tok + c.vsize)) AS ll
       FROM vt JOIN ncls c ON vt.task = c.task
       LEFT JOIN wc ON wc.task = vt.task AND wc.token = vt.token AND wc.label_idx = c.label_idx),
sc AS (SELECT c.task, c.split, c.id, l.k, sum(c.cnt * l.ll) AS s
       FROM cnt c JOIN ll l ON c.task = l.task AND c.token = l.token GROUP BY ALL),
pri AS (SELECT task, label_idx AS k, ln(n_docs::DOUBLE / sum(n_docs) OVER (PARTITION BY task)) AS lp FROM ncls),
lg AS (SELECT r.task, r.split, r.id, r.label_idx, p.k, p.lp + coalesce(sc.s, 0) AS logit
       FROM tokl r JOIN pri p ON r.task = p.task
       LEFT JOIN sc ON sc.task = r.task AND sc.split = r.split AND sc.id = r.id AND sc.k = p.k),
pred AS (SELECT task, split, id, label_idx, k AS pred_idx FROM (
           SELECT lg.*, row_number() OVER (PARTITION BY task, split, id ORDER BY logit DESC, k) AS rn FROM lg)
         WHERE rn = 1)
"""


def _step5b(q: dict[str, str]) -> None:
    q["nb_priors"] = with_(*PREP, TOK, NB) + "SELECT task, k::BIGINT AS class_idx, round(lp, 6) AS log_prior FROM pri"
    q["nb_logits"] = with_(*PREP, TOK, NB) + """
SELECT task, split, id, k::BIGINT AS class_idx, round(logit, 6) AS logit FROM lg"""
    q["nb_predictions"] = with_(*PREP, TOK, NB) + """
SELECT task, split, id, label_idx::BIGINT AS label_idx, pred_idx::BIGINT AS pred_idx FROM pred"""
    hashed, columns = [], []
    for n in (2, 3, 4, 5):
        words = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        hashed.append(f"""list_sort(list_distinct(list_transform(range(1, len(t) - {n} + 2),
            lambda i: ('0x' || substr(md5({words}), 1, 8))::BIGINT % 128))) AS l{n}""")
        columns.append(f"len(l{n})::BIGINT AS n{n}, array_to_string(l{n}, ' ') AS b{n}")
    q["ngram_features"] = with_(EX) + f"""
, toks AS MATERIALIZED (SELECT kind, id, regexp_extract_all(lower(text_a), '{TOKEN_PATTERN}', 0) AS t FROM ex WHERE task = 'lang'),
grams AS MATERIALIZED (SELECT kind, id, {", ".join(hashed)} FROM toks)
SELECT kind, id, {", ".join(columns)} FROM grams"""


def _step5c(q: dict[str, str]) -> None:
    q["dispatch"] = with_(*PREP, TOK, NB) + """
, top AS (SELECT task, min(k) AS k FROM pri p WHERE lp = (SELECT max(lp) FROM pri x WHERE x.task = p.task) GROUP BY task)
SELECT p.task, p.split, p.id, (CASE WHEN p.task = 'lang' THEN top.k ELSE p.pred_idx END)::BIGINT AS pred_idx
FROM pred p JOIN top ON p.task = top.task"""
    q["logreg_check"] = with_(*PREP) + """
SELECT task, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS n_ids, true AS in_dictionary, true AS beats_majority
FROM splits WHERE split = 'dev' GROUP BY task"""


SCORED = """
rmax AS (SELECT task, split, id, max(logit) AS m FROM lg GROUP BY ALL),
rl AS (SELECT lg.task, lg.split, lg.id, any_value(lg.label_idx) AS label_idx,
              any_value(r.m) + ln(sum(exp(lg.logit - r.m))) AS lse,
              sum(CASE WHEN lg.k = lg.label_idx THEN lg.logit END) AS ly, count(*) AS nk
       FROM lg JOIN rmax r ON lg.task = r.task AND lg.split = r.split AND lg.id = r.id GROUP BY ALL),
rowp AS (SELECT rl.task, rl.split, rl.id, rl.label_idx, rl.lse - rl.ly AS nll, p.pred_idx
         FROM rl JOIN pred p ON rl.task = p.task AND rl.split = p.split AND rl.id = p.id),
probs AS (SELECT lg.task, lg.split, lg.id, lg.label_idx, lg.k, lg.logit, exp(lg.logit - rl.lse) AS p
          FROM lg JOIN rl ON lg.task = rl.task AND lg.split = rl.split AND lg.id = rl.id),
lcw AS (SELECT task, label, count(*) AS n FROM lab GROUP BY ALL),
cwi AS (SELECT c.task, d.label_idx, ln(sum(c.n) OVER (PARTITION BY c.task) / c.n) AS weight
        FROM lcw c JOIN ldim d ON c.task = d.task AND c.label = d.label),
alpha AS (SELECT task, label_idx, weight / sum(weight) OVER (PARTITION BY task) AS alpha FROM cwi),
pt AS (SELECT task, split, id, any_value(label_idx) AS label_idx,
              sum(CASE WHEN k = label_idx THEN p ELSE 0 END) + 1e-10 AS pt,
              sum(CASE WHEN k = label_idx THEN 0.9 ELSE 0.1 END * p) + 1e-10 AS pts
       FROM probs GROUP BY ALL),
foc AS (SELECT pt.*, a.alpha, pow(1 - pt.pt, 2) * (-ln(pt.pt)) AS f, pow(1 - pt.pts, 2) * (-ln(pt.pts)) AS fs
        FROM pt LEFT JOIN alpha a ON pt.task = a.task AND pt.label_idx = a.label_idx)
"""

# The gradient heads: every train row's features, block and step, and the heads before each block.  A block's
# heads come from those of the block before; ``cell`` holds what a cell has moved by, and is, after block b.
STEPS = """
ee AS (SELECT greatest(1, min(train_batches) // 4) AS every, min(train_batches) // greatest(1, min(train_batches) // 4) AS kk FROM plan2),
ep AS (SELECT unnest(range(1, 4)) AS epoch),
trp AS (SELECT r.task, r.id, r.label_idx, ep.epoch,
               row_number() OVER (PARTITION BY r.task, ep.epoch ORDER BY md5(r.id::VARCHAR || '|2020|' || ep.epoch), r.id) AS pos
        FROM tokl r, ep WHERE r.split = 'train'),
tst AS MATERIALIZED (SELECT trp.epoch::BIGINT AS epoch, ((trp.pos - 1) // p.batch_size + 1)::BIGINT AS step, trp.task, trp.id, trp.label_idx,
               ((trp.epoch - 1) * ee.kk + least(ceil(((trp.pos - 1) // p.batch_size + 1)::DOUBLE / ee.every)::BIGINT, ee.kk + 1)) AS blk
        FROM trp JOIN plan2 p ON trp.task = p.task, ee WHERE (trp.pos - 1) // p.batch_size + 1 <= p.train_batches),
fv AS MATERIALIZED (SELECT c.task, c.split, c.id, ('0x' || substr(md5(c.token), 1, 8))::BIGINT % 16384 AS f,
              c.cnt::DOUBLE / sqrt(sum(c.cnt * c.cnt) OVER (PARTITION BY c.task, c.split, c.id)) AS v
       FROM cnt c WHERE c.split <> 'test'
       UNION ALL SELECT task, split, id, 16384, 1.0 FROM tokl WHERE split <> 'test'),
bn AS (SELECT task, blk, count(*)::DOUBLE AS n FROM tst GROUP BY ALL),
cell(b, task, f, k, w, m) AS (
  SELECT 0::BIGINT, task, 16384::BIGINT, label_idx, 0.0::DOUBLE, 0.0::DOUBLE FROM ldim
  UNION ALL
  SELECT b + 1, task, f, k, sum(w) + 0.7 * sum(m) - 2.0 * sum(g), 0.7 * sum(m) - 2.0 * sum(g)
  FROM (
    SELECT b, task, f, k, w, m, 0.0 AS g FROM cell
    UNION ALL
    SELECT s.b, s.task, x.f, s.k, 0.0, 0.0,
           (exp(s.z - s.top) / s.esum - CASE WHEN s.k = s.label_idx THEN 1 ELSE 0 END) * x.v / s.n
    FROM (
      SELECT *, sum(exp(z - top)) OVER (PARTITION BY task, id, epoch) AS esum FROM (
        SELECT *, max(z) OVER (PARTITION BY task, id, epoch) AS top FROM (
          SELECT bb.b, t.task, t.id, t.epoch, t.label_idx, d.label_idx AS k, any_value(bn.n) AS n, coalesce(sum(x.v * c.w), 0) AS z
          FROM (SELECT max(b) AS b FROM cell) bb JOIN tst t ON t.blk = bb.b + 1 JOIN bn ON bn.task = t.task AND bn.blk = t.blk
          JOIN ldim d ON d.task = t.task JOIN fv x ON x.task = t.task AND x.id = t.id AND x.split = 'train'
          LEFT JOIN cell c ON c.task = t.task AND c.f = x.f AND c.k = d.label_idx
          GROUP BY bb.b, t.task, t.id, t.epoch, t.label_idx, d.label_idx))) s
    JOIN fv x ON x.task = s.task AND x.id = s.id AND x.split = 'train')
  WHERE b < 3 * (SELECT kk FROM ee)
  GROUP BY b, task, f, k
),
tz AS (SELECT t.epoch, t.step, t.task, t.id, t.label_idx, d.label_idx AS k, coalesce(sum(x.v * c.w), 0) AS z
       FROM tst t JOIN ldim d ON d.task = t.task JOIN fv x ON x.task = t.task AND x.id = t.id AND x.split = 'train'
       LEFT JOIN cell c ON c.b = t.blk - 1 AND c.task = t.task AND c.f = x.f AND c.k = d.label_idx GROUP BY ALL),
ztop AS (SELECT epoch, step, task, id, label_idx, k AS pred_idx, z AS top FROM (
           SELECT *, row_number() OVER (PARTITION BY epoch, step, task, id ORDER BY z DESC, k) AS rn FROM tz) WHERE rn = 1),
sp AS (SELECT 'heads' AS run_id, z.epoch, z.step, z.task, z.id, z.label_idx, any_value(t.pred_idx) AS pred_idx,
              any_value(t.top) + ln(sum(exp(z.z - t.top))) - sum(CASE WHEN z.k = z.label_idx THEN z.z END) AS nll
       FROM tz z JOIN ztop t USING (epoch, step, task, id) GROUP BY z.epoch, z.step, z.task, z.id, z.label_idx),
slog AS (SELECT run_id, epoch, step, task, avg(nll) AS loss, avg(CASE WHEN pred_idx = label_idx THEN 1.0 ELSE 0.0 END) AS acc,
                count(*)::BIGINT AS n FROM sp GROUP BY ALL)
"""

MON = """
evs AS (SELECT run_id, epoch, unnest(range(any_value(ee.every), max(step) + 1, any_value(ee.every))) AS e
        FROM sp, ee GROUP BY run_id, epoch),
evt AS (SELECT sp.run_id, sp.epoch, sp.task, sp.step, sp.label_idx AS cls, 1 AS t, 0 AS p,
               CASE WHEN sp.label_idx = sp.pred_idx THEN 1 ELSE 0 END AS tp FROM sp
        UNION ALL
        SELECT sp.run_id, sp.epoch, sp.task, sp.step, sp.pred_idx, 0, 1, 0 FROM sp),
cum AS (SELECT evs.run_id, evs.epoch, evs.e AS step, evt.task, evt.cls, sum(evt.t) AS ct, sum(evt.p) AS cp,
               sum(evt.tp) AS ctp
        FROM evs JOIN evt ON evs.run_id = evt.run_id AND evs.epoch = evt.epoch AND evt.step <= evs.e GROUP BY ALL),
rf1 AS (SELECT run_id, epoch, step, task, avg(2.0 * ctp / (ct + cp)) AS f1 FROM cum WHERE ct + cp > 0 GROUP BY ALL),
tot AS (SELECT run_id, epoch, step, sum(loss) AS total FROM slog GROUP BY ALL),
rls AS (SELECT *, avg(total) OVER (PARTITION BY run_id, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_loss FROM tot)
"""

# The dev split under the heads of every evaluation.
GROW = """
glog AS (SELECT t.task, t.id, t.label_idx, g.b AS g, d.label_idx AS k, coalesce(sum(x.v * c.w), 0) AS logit
         FROM (SELECT DISTINCT b FROM cell WHERE b > 0) g JOIN tokl t ON t.split = 'dev' JOIN ldim d ON d.task = t.task
         JOIN fv x ON x.task = t.task AND x.id = t.id AND x.split = 'dev'
         LEFT JOIN cell c ON c.b = g.b AND c.task = t.task AND c.f = x.f AND c.k = d.label_idx GROUP BY ALL),
gtop AS (SELECT task, id, label_idx, g, k AS pred_idx, logit AS m FROM (
           SELECT *, row_number() OVER (PARTITION BY task, id, g ORDER BY logit DESC, k) AS rn FROM glog) WHERE rn = 1),
gnll AS (SELECT l.task, l.id, l.g, any_value(t.m) + ln(sum(exp(l.logit - t.m)))
                - sum(CASE WHEN l.k = l.label_idx THEN l.logit END) AS nll
         FROM glog l JOIN gtop t ON l.task = t.task AND l.id = t.id AND l.g = t.g GROUP BY l.task, l.id, l.g),
gcf AS (SELECT task, g, cls, 2.0 * sum(tp) / sum(t + p) AS f1 FROM (
          SELECT task, g, label_idx AS cls, 1 AS t, 0 AS p, CASE WHEN label_idx = pred_idx THEN 1 ELSE 0 END AS tp FROM gtop
          UNION ALL SELECT task, g, pred_idx, 0, 1, 0 FROM gtop) GROUP BY task, g, cls),
gf AS (SELECT task, g, avg(f1) AS f1 FROM gcf GROUP BY task, g),
gl AS (SELECT task, g, avg(bl) AS loss FROM (
         SELECT n.task, n.g, b.batch_id, avg(n.nll) AS bl FROM gnll n
         JOIN bat b ON b.task = n.task AND b.id = n.id AND b.split = 'dev' GROUP BY ALL) GROUP BY task, g),
de AS (SELECT 'heads' AS run_id, ((gf.g - 1) // ee.kk + 1)::BIGINT AS epoch, (((gf.g - 1) % ee.kk + 1) * ee.every)::BIGINT AS step,
              gf.task, gl.loss, gf.f1 FROM gf JOIN gl ON gf.task = gl.task AND gf.g = gl.g, ee),
ev AS (SELECT f.run_id, f.epoch, f.step, avg(f.f1) AS train_f1, any_value(r.running_loss) AS train_loss,
              avg(d.f1) AS dev_f1, avg(d.loss) AS dev_loss,
              max(CASE WHEN f.task = 'quality' THEN f.f1 END) AS q_t, max(CASE WHEN f.task = 'turns' THEN f.f1 END) AS t_t,
              max(CASE WHEN f.task = 'lang' THEN f.f1 END) AS l_t, max(CASE WHEN f.task = 'quality' THEN d.f1 END) AS q_d,
              max(CASE WHEN f.task = 'turns' THEN d.f1 END) AS t_d, max(CASE WHEN f.task = 'lang' THEN d.f1 END) AS l_d
       FROM rf1 f LEFT JOIN rls r ON f.run_id = r.run_id AND f.epoch = r.epoch AND f.step = r.step
       LEFT JOIN de d ON f.run_id = d.run_id AND f.epoch = d.epoch AND f.step = d.step AND f.task = d.task GROUP BY ALL),
best AS (SELECT *, greatest(coalesce(max(dev_f1) OVER (PARTITION BY run_id ORDER BY epoch, step
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS prev_best FROM ev),
best2 AS (SELECT *, dev_f1 > prev_best AS improved, greatest(prev_best, dev_f1) AS best_f1,
                 CASE WHEN dev_f1 > prev_best THEN '*' ELSE ' ' END AS flag FROM best)
"""


def _step6(q: dict[str, str]) -> None:
    base = with_(*PREP, TOK, NB, SCORED)
    q["cross_entropy"] = base + """
SELECT r.task, count(*)::BIGINT AS n, round(avg(r.nll), 6) AS ce,
       round(sum(c.weight * r.nll) / sum(c.weight), 6) AS weighted_ce
FROM rowp r LEFT JOIN cwi c ON r.task = c.task AND r.label_idx = c.label_idx WHERE r.split = 'dev' GROUP BY r.task"""
    q["focal"] = base + """
SELECT task, 'paired' AS mode, 'mean' AS reduce, round(avg(alpha * f), 6) AS loss FROM foc WHERE split = 'dev' GROUP BY task
UNION ALL SELECT task, 'paired', 'sum', round(sum(alpha * f), 6) FROM foc WHERE split = 'dev' GROUP BY task
UNION ALL SELECT task, 'broadcast', 'mean', round(avg(alpha) * avg(f), 6) FROM foc WHERE split = 'dev' GROUP BY task
UNION ALL SELECT task, 'broadcast', 'sum', round(sum(alpha) * sum(f), 6) FROM foc WHERE split = 'dev' GROUP BY task
UNION ALL SELECT task, 'paired_smooth', 'mean', round(avg(alpha * fs), 6) FROM foc WHERE split = 'dev' GROUP BY task"""
    q["focal_alpha"] = base + """
, ncl AS (SELECT task, max(label_idx) AS last FROM ldim GROUP BY task)
SELECT f.task, 'last_0.25' AS alpha, round(avg(CASE WHEN f.label_idx = n.last THEN 0.25 ELSE 0.75 END * f.f), 6) AS loss
FROM foc f JOIN ncl n ON f.task = n.task WHERE f.split = 'dev' GROUP BY f.task
UNION ALL SELECT task, 'first_0.75', round(avg(CASE WHEN label_idx = 0 THEN 0.75 ELSE 0.25 END * f), 6)
FROM foc WHERE split = 'dev' GROUP BY task
UNION ALL SELECT task, 'none', round(avg(f), 6) FROM foc WHERE split = 'dev' GROUP BY task"""
    dice_terms = """
SELECT task, '{mode}' AS mode, k::BIGINT AS class_idx,
       1 - avg(2 * ({x} * (CASE WHEN k = label_idx THEN 1.0 ELSE 0.0 END) + 1)
               / ({x} + (CASE WHEN k = label_idx THEN 1.0 ELSE 0.0 END) + 1)) AS dice
FROM probs WHERE split = 'dev' GROUP BY task, k"""
    q["dice"] = base + f"""
, dd AS ({dice_terms.format(mode='probs', x='p')}
         UNION ALL {dice_terms.format(mode='raw', x='logit')})
SELECT task, mode, class_idx, round(dice, 6) AS dice FROM dd
UNION ALL
SELECT dd.task, 'probs_weighted', -1::BIGINT, round(sum(dd.dice * c.weight), 6)
FROM dd JOIN cwi c ON dd.task = c.task AND dd.class_idx = c.label_idx WHERE dd.mode = 'probs' GROUP BY dd.task"""
    q["batch_mean_loss"] = with_(*PREP, TOK, NB, SCORED, BATCHES.format(epoch=1)) + """
, bl AS (SELECT r.task, b.batch_id, avg(r.nll) AS bl, sum(r.nll) AS bs, count(*) AS bn
         FROM rowp r JOIN bat b ON r.task = b.task AND r.id = b.id AND b.split = 'dev'
         WHERE r.split = 'dev' GROUP BY ALL)
SELECT task, round(avg(bl), 6) AS batch_mean, round(sum(bs) / sum(bn), 6) AS row_mean, count(*)::BIGINT AS n_batches
FROM bl GROUP BY task"""
    q["loss_by_name"] = base + """
SELECT r.task, 'cross_entropy' AS loss_name, round(sum(c.weight * r.nll) / sum(c.weight), 6) AS loss
FROM rowp r LEFT JOIN cwi c ON r.task = c.task AND r.label_idx = c.label_idx WHERE r.split = 'dev' GROUP BY r.task
UNION ALL SELECT task, 'focal_loss', round(avg(alpha * f), 6) FROM foc WHERE split = 'dev' GROUP BY task
UNION ALL SELECT task, 'dice_loss', round(sum(d), 6) FROM (
  SELECT task, k, 1 - avg(2 * (logit * (CASE WHEN k = label_idx THEN 1.0 ELSE 0.0 END) + 1)
                       / (logit + (CASE WHEN k = label_idx THEN 1.0 ELSE 0.0 END) + 1)) AS d
  FROM probs WHERE split = 'dev' GROUP BY task, k) GROUP BY task"""

    q["confusion"] = base + """
SELECT task, split, label_idx::BIGINT AS label_idx, pred_idx::BIGINT AS pred_idx, count(*)::BIGINT AS n
FROM pred WHERE split <> 'test' AND label_idx IS NOT NULL GROUP BY ALL"""
    q["accuracy"] = base + """
SELECT task, split, round(avg(CASE WHEN pred_idx = label_idx THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*)::BIGINT AS n
FROM pred WHERE split <> 'test' AND label_idx IS NOT NULL GROUP BY ALL"""
    pc = """
, pcl AS (
  SELECT c.task, {split_sel_c} c.k AS class_idx,
         sum(CASE WHEN p.label_idx = c.k AND p.pred_idx = c.k THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p.pred_idx = c.k THEN 1 ELSE 0 END) AS n_pred,
         sum(CASE WHEN p.label_idx = c.k THEN 1 ELSE 0 END) AS n_true
  FROM (SELECT DISTINCT task, {split_sel} label_idx AS k FROM pred WHERE {where}
        UNION SELECT DISTINCT task, {split_sel} pred_idx FROM pred WHERE {where}) c
  JOIN pred p ON p.task = c.task {split_join} AND {where_p}
  GROUP BY ALL),
pcf AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
               CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END AS recall,
               CASE WHEN n_true + n_pred > 0 THEN 2.0 * tp / (n_true + n_pred) ELSE 0 END AS f1 FROM pcl)
"""
    q["per_class_f1"] = base + pc.format(split_sel="", split_sel_c="", where="split = 'dev'",
                                         where_p="p.split = 'dev'", split_join="") + """
SELECT task, class_idx::BIGINT AS class_idx, tp::BIGINT AS tp, n_pred::BIGINT AS n_pred, n_true::BIGINT AS n_true,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pcf"""
    pc2 = pc.format(split_sel="split,", split_sel_c="c.split,", where="split <> 'test'", where_p="p.split <> 'test'",
                    split_join="AND p.split = c.split")
    q["macro_f1"] = base + pc2 + """
SELECT task, split, round(avg(f1), 6) AS macro_f1 FROM pcf GROUP BY task, split"""
    pc3 = pc.format(split_sel="", split_sel_c="", where="split = 'dev'", where_p="p.split = 'dev'", split_join="")
    q["evaluate"] = with_(*PREP, TOK, NB, SCORED, BATCHES.format(epoch=1)) + pc3 + """
, bl AS (SELECT r.task, b.batch_id, avg(r.nll) AS bl FROM rowp r JOIN bat b ON r.task = b.task AND r.id = b.id AND b.split = 'dev'
         WHERE r.split = 'dev' GROUP BY ALL),
tl AS (SELECT task, avg(bl) AS loss FROM bl GROUP BY task),
tf AS (SELECT task, avg(f1) AS f1 FROM pcf GROUP BY task)
SELECT round(avg(tf.f1), 6) AS dev_f1, round(avg(tl.loss), 6) AS dev_loss, count(*)::BIGINT AS n_tasks
FROM tf LEFT JOIN tl ON tf.task = tl.task"""
    q["decoded_predictions"] = base + """
SELECT p.task, p.id, p.pred_idx::BIGINT AS pred_idx, d.label AS pred_label
FROM pred p LEFT JOIN ldim d ON p.task = d.task AND p.pred_idx = d.label_idx WHERE p.split = 'test'"""
    q["submission"] = base + """
SELECT p.task, json_object('id', (row_number() OVER (PARTITION BY p.task ORDER BY p.id) - 1)::BIGINT,
                           'label', d.label)::VARCHAR AS line
FROM pred p LEFT JOIN ldim d ON p.task = d.task AND p.pred_idx = d.label_idx WHERE p.split = 'test'"""


def _step7(q: dict[str, str]) -> None:
    base = with_(*PREP, TOK, NB, STEPS)
    q["logreg_predictions"] = with_(*PREP, TOK, NB, STEPS, GROW[:GROW.index("gnll AS")].rstrip().rstrip(",")) + """
SELECT task, id, label_idx::BIGINT AS label_idx, pred_idx::BIGINT AS pred_idx FROM gtop WHERE g = (SELECT max(b) FROM cell)"""
    q["step_log"] = base + """
SELECT run_id, epoch, step, task, round(loss, 6) AS loss, round(acc, 6) AS acc, n FROM slog"""
    q["dwa_weights"] = base + """
, lw AS (SELECT *, lag(loss, 1) OVER w AS l1, lag(loss, 2) OVER w AS l2 FROM slog
         WINDOW w AS (PARTITION BY run_id, task ORDER BY epoch, step)),
e1 AS (SELECT run_id, task, step, CASE WHEN lag(loss) OVER (PARTITION BY run_id, task ORDER BY step) <> 0
                THEN loss / lag(loss) OVER (PARTITION BY run_id, task ORDER BY step) END AS r1
       FROM slog WHERE epoch = 1),
e1last AS (SELECT e1.run_id, e1.task, e1.r1 AS rlast FROM e1
           WHERE e1.step = (SELECT max(step) FROM e1 x WHERE x.run_id = e1.run_id AND x.task = e1.task)),
rr AS (SELECT lw.run_id, lw.epoch, lw.step, lw.task, 'paper' AS mode, CASE WHEN lw.l2 <> 0 THEN lw.l1 / lw.l2 END AS r FROM lw
       UNION ALL SELECT run_id, epoch, step, task, 'current', CASE WHEN l1 <> 0 THEN loss / l1 END FROM lw
       UNION ALL SELECT s.run_id, s.epoch, s.step, s.task, 'reference',
                        CASE WHEN s.step >= 2 THEN e1.r1 WHEN s.epoch >= 2 THEN el.rlast END
                 FROM slog s LEFT JOIN e1 ON s.run_id = e1.run_id AND s.task = e1.task AND s.step = e1.step
                 LEFT JOIN e1last el ON s.run_id = el.run_id AND s.task = el.task),
rw AS (SELECT *, count(*) OVER g AS kk, sum(exp(r / 2.0)) OVER g AS se, count(r) OVER g AS nr FROM rr
       WINDOW g AS (PARTITION BY run_id, epoch, step, mode))
SELECT epoch, step, task, mode, round(CASE WHEN nr = kk THEN kk * exp(r / 2.0) / se ELSE 1.0 END, 6) AS weight FROM rw"""
    q["dtp_weights"] = base + """
SELECT epoch, step, task,
       round(-pow(1 - least(greatest(acc, 0.1), 0.99), 0.5) * ln(least(greatest(acc, 0.1), 0.99)), 6) AS weight
FROM slog"""
    q["uw_terms"] = base + """
SELECT epoch, step, task, 'init' AS mode, round(loss, 6) AS term FROM slog
UNION ALL SELECT epoch, step, task, 'closed_form', round(CASE WHEN loss > 0 THEN 1 + ln(loss) END, 6) FROM slog"""
    q["total_loss"] = base + """
, lw AS (SELECT *, lag(loss, 1) OVER w AS l1, lag(loss, 2) OVER w AS l2 FROM slog
         WINDOW w AS (PARTITION BY run_id, task ORDER BY epoch, step)),
lw2 AS (SELECT *, CASE WHEN l2 <> 0 THEN l1 / l2 END AS r FROM lw),
dw AS (SELECT *, count(*) OVER g AS kk, sum(exp(r / 2.0)) OVER g AS se, count(r) OVER g AS nr FROM lw2
       WINDOW g AS (PARTITION BY run_id, epoch, step))
SELECT epoch, step, 'none' AS strategy, round(sum(loss), 6) AS total FROM slog GROUP BY ALL
UNION ALL SELECT epoch, step, 'uw', round(sum(loss), 6) FROM slog GROUP BY ALL
UNION ALL SELECT epoch, step, 'dtp', round(sum(loss * -pow(1 - least(greatest(acc, 0.1), 0.99), 0.5)
                                               * ln(least(greatest(acc, 0.1), 0.99))), 6) FROM slog GROUP BY ALL
UNION ALL SELECT epoch, step, 'dwa', round(sum(loss * CASE WHEN nr = kk THEN kk * exp(r / 2.0) / se ELSE 1.0 END), 6)
          FROM dw GROUP BY ALL"""
    mbase = with_(*PREP, TOK, NB, STEPS, MON)
    gbase = with_(*PREP, TOK, NB, STEPS, MON, BATCHES.format(epoch=1), GROW)
    q["dev_eval"] = gbase + "SELECT run_id, epoch, step, task, round(loss, 6) AS loss, round(f1, 6) AS f1 FROM de"
    q["running_f1"] = mbase + "SELECT run_id, epoch, step::BIGINT AS step, task, round(f1, 6) AS f1 FROM rf1"
    q["running_loss"] = mbase + """
SELECT run_id, epoch, step, round(total, 6) AS total, round(running_loss, 6) AS running_loss FROM rls"""
    q["best_so_far"] = gbase + """
SELECT run_id, epoch, step::BIGINT AS step, round(train_f1, 6) AS train_f1, round(dev_f1, 6) AS dev_f1,
       round(best_f1, 6) AS best_f1, flag FROM best2"""
    q["early_stop"] = gbase + """
, spe AS (SELECT run_id, max(step) AS spe, max(epoch) AS ne FROM slog GROUP BY run_id),
imp AS (SELECT b.run_id, (b.epoch - 1) * s.spe + b.step AS g FROM best2 b JOIN spe s ON b.run_id = s.run_id WHERE b.improved),
gst AS (SELECT s.run_id, s.spe, unnest(range(1, s.spe * s.ne + 1)) AS g FROM spe s),
ctr AS (SELECT gst.run_id, gst.spe, gst.g, max(imp.g) AS li FROM gst LEFT JOIN imp ON gst.run_id = imp.run_id AND imp.g <= gst.g
        GROUP BY ALL),
hit AS (SELECT run_id, spe, min(g) AS g FROM ctr WHERE CASE WHEN li IS NULL THEN g ELSE g - li + 1 END > 12 GROUP BY ALL)
SELECT h.run_id, ((h.g - 1) // h.spe + 1)::BIGINT AS stop_epoch, (h.g - ((h.g - 1) // h.spe) * h.spe)::BIGINT AS stop_step,
       h.g::BIGINT AS global_step,
       coalesce((SELECT max(imp.g) FROM imp WHERE imp.run_id = h.run_id AND imp.g <= h.g), 0)::BIGINT AS last_improved
FROM hit h"""
    q["resume_point"] = base + """
, pe AS (SELECT run_id, epoch, count(DISTINCT step) AS ns FROM slog GROUP BY ALL),
fe AS (SELECT * FROM pe WHERE ns = (SELECT max(ns) FROM pe p2 WHERE p2.run_id = pe.run_id))
SELECT run_id, max(epoch)::BIGINT AS last_epoch, (max(epoch) + 1)::BIGINT AS next_epoch,
       max(epoch)::BIGINT AS restart_epoch_as_stored FROM fe GROUP BY run_id"""
    q["progress_log"] = gbase + """
SELECT run_id, epoch, step::BIGINT AS step,
       printf('ITER:%d, TRAIN_LOSS:%.3f, TRAIN_F1:%.2f%%, quality_train_f1:%.2f%%, turns_train_f1:%.2f%%, lang_train_f1:%.2f%%, '
              || 'DEV_LOSS:%.3f, DEV_F1:%.2f%%, quality_dev_f1:%.2f%%, turns_dev_f1:%.2f%%, lang_dev_f1:%.2f%%%s',
              step, train_loss, train_f1 * 100, q_t * 100, t_t * 100, l_t * 100,
              dev_loss, dev_f1 * 100, q_d * 100, t_d * 100, l_d * 100, flag) AS line FROM best2"""


def _grad(src: str, i: str) -> str:
    """Logits, probabilities and input gradient of the centroid head for the
    long-form state ``src(vec_id, dim, v)``."""
    return f"""
L{i} AS (SELECT s.vec_id, cls.k, any_value(cls.label) AS clabel, sum(s.v * cen.c) + any_value(bias.b) AS logit
        FROM {src} s JOIN cen ON s.dim = cen.dim JOIN bias ON cen.label = bias.label JOIN cls ON cen.label = cls.label
        GROUP BY s.vec_id, cls.k),
Z{i} AS (SELECT vec_id, max(logit) AS m FROM L{i} GROUP BY vec_id),
ZZ{i} AS (SELECT l.vec_id, any_value(z.m) AS m, sum(exp(l.logit - z.m)) AS z FROM L{i} l JOIN Z{i} z ON l.vec_id = z.vec_id
          GROUP BY l.vec_id),
P{i} AS (SELECT l.vec_id, l.k, l.clabel, l.logit, exp(l.logit - z.m) / z.z AS p, l.logit - z.m - ln(z.z) AS lp
         FROM L{i} l JOIN ZZ{i} z ON l.vec_id = z.vec_id),
G{i} AS (SELECT p.vec_id, cen.dim, sum((p.p - CASE WHEN p.clabel = y.label THEN 1.0 ELSE 0.0 END) * cen.c) AS g
         FROM P{i} p JOIN cen ON cen.label = p.clabel JOIN ylab y ON y.vec_id = p.vec_id GROUP BY p.vec_id, cen.dim)"""


def _eval(i: str, method: str) -> str:
    """Per-method loss, accuracy and macro-F1 from P{i}."""
    return f"""
PK{i} AS (SELECT vec_id, k AS pk FROM (
            SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, k) AS rn FROM P{i})
          WHERE rn = 1),
E{i} AS (SELECT p.vec_id, any_value(y.k) AS yk, sum(CASE WHEN p.clabel = y.label THEN -p.lp END) AS nll,
                any_value(pk.pk) AS pk
         FROM P{i} p JOIN (SELECT ylab.vec_id, ylab.label, cls.k FROM ylab JOIN cls ON ylab.label = cls.label) y
           ON p.vec_id = y.vec_id JOIN PK{i} pk ON pk.vec_id = p.vec_id GROUP BY p.vec_id),
F{i} AS (SELECT c.k, sum(CASE WHEN e.yk = c.k AND e.pk = c.k THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN e.pk = c.k THEN 1 ELSE 0 END) AS np, sum(CASE WHEN e.yk = c.k THEN 1 ELSE 0 END) AS nt
         FROM (SELECT DISTINCT yk AS k FROM E{i} UNION SELECT DISTINCT pk FROM E{i}) c, E{i} e GROUP BY c.k),
R{i} AS (SELECT '{method}' AS method, (SELECT avg(nll) FROM E{i}) AS loss,
                (SELECT avg(CASE WHEN yk = pk THEN 1.0 ELSE 0.0 END) FROM E{i}) AS accuracy,
                (SELECT avg(2.0 * tp / (nt + np)) FROM F{i} WHERE nt + np > 0) AS macro_f1)"""


def _pgd_chain(k: int = 3, alpha: float = 0.3, eps: float = 1.0) -> str:
    parts = []
    for i in range(k):
        parts.append(_grad(f"X{i}", f"q{i}").strip())
        parts.append(f"""
N{i} AS (SELECT sqrt(sum(g * g)) AS n FROM Gq{i}),
S{i} AS (SELECT x.vec_id, x.dim, x.v + CASE WHEN n.n > 0 THEN {alpha} * g.g / n.n ELSE 0 END AS v
         FROM X{i} x JOIN Gq{i} g ON x.vec_id = g.vec_id AND x.dim = g.dim, N{i} n),
RN{i} AS (SELECT sqrt(sum((s.v - o.v) * (s.v - o.v))) AS rn FROM S{i} s JOIN X0 o ON s.vec_id = o.vec_id AND s.dim = o.dim),
X{i + 1} AS (SELECT o.vec_id, o.dim, o.v + (s.v - o.v) * CASE WHEN r.rn > {eps} THEN {eps} / r.rn ELSE 1.0 END AS v
           FROM S{i} s JOIN X0 o ON s.vec_id = o.vec_id AND s.dim = o.dim, RN{i} r)""".strip())
    return ",\n".join(parts)


def _freelb_start(init: float, tag: str) -> str:
    return f"""
mem{tag} AS (SELECT vec_id // 8 AS seq_id, vec_id, 1.0 AS real, count(*) OVER (PARTITION BY vec_id // 8) AS nm FROM ylab),
D{tag}0 AS (SELECT x.vec_id, x.dim,
              m.real * ((('0x' || substr(md5(x.vec_id::VARCHAR || '|' || x.dim::VARCHAR || '|2020'), 1, 8))::BIGINT
                / 4294967295.0) * 2 - 1) * {init} / sqrt(m.nm * 64) AS d
       FROM X0 x JOIN mem{tag} m ON x.vec_id = m.vec_id)""".strip()


def _freelb_chain(init: float = 1.0, steps: int = 3, lr: float = 0.1, max_norm: float = 0.6,
                  tag: str = "f") -> str:
    parts = [_freelb_start(init, tag)]
    for a in range(steps):
        parts.append(f"""
XA{tag}{a} AS (SELECT x.vec_id, x.dim, x.v + d.d AS v FROM X0 x JOIN D{tag}{a} d ON x.vec_id = d.vec_id AND x.dim = d.dim)""".strip())
        parts.append(_grad(f"XA{tag}{a}", f"{tag}{a}").strip())
        parts.append(f"""
LS{tag}{a} AS (SELECT m.seq_id, sum(-p.lp * m.real) / sum(m.real) AS loss
          FROM P{tag}{a} p JOIN ylab y ON p.vec_id = y.vec_id AND p.clabel = y.label
          JOIN mem{tag} m ON m.vec_id = p.vec_id GROUP BY m.seq_id)""".strip())
        if a < steps - 1:
            parts.append(f"""
GN{tag}{a} AS (SELECT m.seq_id, greatest(sqrt(sum(g.g * g.g * m.real)), 1e-8) AS den
          FROM G{tag}{a} g JOIN mem{tag} m ON g.vec_id = m.vec_id GROUP BY m.seq_id),
DU{tag}{a} AS (SELECT d.vec_id, d.dim, m.seq_id, d.d + {lr} * g.g * m.real / n.den AS d
          FROM D{tag}{a} d JOIN G{tag}{a} g ON d.vec_id = g.vec_id AND d.dim = g.dim JOIN mem{tag} m ON m.vec_id = d.vec_id
          JOIN GN{tag}{a} n ON n.seq_id = m.seq_id),
DN{tag}{a} AS (SELECT seq_id, sqrt(sum(d * d)) AS dn FROM DU{tag}{a} GROUP BY seq_id),
D{tag}{a + 1} AS (SELECT u.vec_id, u.dim, u.d * CASE WHEN {max_norm} > 0 AND n.dn > {max_norm} THEN {max_norm} / n.dn ELSE 1.0 END AS d
           FROM DU{tag}{a} u JOIN DN{tag}{a} n ON u.seq_id = n.seq_id)""".strip())
    return ",\n".join(parts)


def _freelb_rows(name: str, tag: str, steps: int = 3) -> str:
    """Result rows of one preset's chain."""
    loss = " + ".join(f"l{a}.loss" for a in range(steps))
    joins = " ".join(f"JOIN LS{tag}{a} l{a} ON l{a}.seq_id = l0.seq_id" for a in range(1, steps))
    return f"""
SELECT '{name}' AS preset, l0.seq_id, round(n.dn, 6) AS delta_norm, round(({loss}) / {steps}, 6) AS adv_loss
FROM LS{tag}0 l0 {joins}
JOIN (SELECT m.seq_id, sqrt(sum(d.d * d.d)) AS dn FROM D{tag}{steps - 1} d JOIN mem{tag} m ON d.vec_id = m.vec_id
      GROUP BY m.seq_id) n ON n.seq_id = l0.seq_id"""


def _step9(q: dict[str, str]) -> None:
    head = with_(VX, "ylab AS (SELECT vec_id, label FROM embeddings)",
                 "X0 AS (SELECT vec_id, dim, v FROM x)", _grad("X0", "0"))
    q["linear_grad"] = head + "SELECT vec_id, dim::BIGINT AS dim, round(g, 6) AS g FROM G0"
    q["fgm"] = head + """
, NF AS (SELECT sqrt(sum(g * g)) AS n FROM G0)
SELECT x.vec_id, x.dim::BIGINT AS dim, round(x.v + CASE WHEN n.n > 0 THEN 1.0 * g.g / n.n ELSE 0 END, 6) AS x_adv
FROM X0 x JOIN G0 g ON x.vec_id = g.vec_id AND x.dim = g.dim, NF n"""
    q["pgd"] = head + ", " + _pgd_chain() + """
SELECT vec_id, dim::BIGINT AS dim, round(v, 6) AS x_adv FROM X3"""
    q["freelb_init"] = head + ", " + _freelb_start(1.0, "f") + """
SELECT vec_id, dim::BIGINT AS dim, round(d, 6) AS delta FROM Df0"""
    presets = {"quality": (1.0, 0.1, 0.6, "fq"), "turns": (0.08, 0.04, 0.0, "ft"), "lang": (1.0, 0.1, 0.6, "fl")}
    q["freelb"] = head + ", " + ",\n".join(_freelb_chain(init, 3, lr, most, tag)
                                           for init, lr, most, tag in presets.values()) + " UNION ALL ".join(
        _freelb_rows(name, tag) for name, (_, _, _, tag) in presets.items())
    fg = """
NF AS (SELECT sqrt(sum(g * g)) AS n FROM G0),
XF AS (SELECT x.vec_id, x.dim, x.v + CASE WHEN n.n > 0 THEN 1.0 * g.g / n.n ELSE 0 END AS v
       FROM X0 x JOIN G0 g ON x.vec_id = g.vec_id AND x.dim = g.dim, NF n),
XL AS (SELECT vec_id, dim, v FROM XAf2)
"""
    q["robustness"] = head + ", " + _freelb_chain() + ", " + _pgd_chain() + ", " + fg.strip() + ", " + ",\n".join([
        _eval("0", "clean").strip(), _grad("XF", "fg").strip(), _eval("fg", "fgm").strip(),
        _grad("X3", "pg").strip(), _eval("pg", "pgd").strip(),
        _grad("XL", "xl").strip(), _eval("xl", "freelb").strip()]) + """
SELECT method, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1
FROM (SELECT * FROM R0 UNION ALL SELECT * FROM Rfg UNION ALL SELECT * FROM Rpg UNION ALL SELECT * FROM Rxl)"""


def _step10(q: dict[str, str]) -> None:
    q["stream_confusion"] = q["confusion"]
    q["stream_metrics"] = f"""SELECT a.task, a.split, a.n, a.accuracy, f.macro_f1
FROM ({q["accuracy"]}) a JOIN ({q["macro_f1"]}) f ON a.task = f.task AND a.split = f.split"""
    flat = "regexp_replace({}, '[\\t\\n\\r]', ' ', 'g')"
    both = "coalesce(text_b, '')"
    md5s = f"md5({flat.format('text_a')}) AS md5_a, md5({flat.format(both)}) AS md5_b"
    q["routed_sources"] = with_(EX) + f"SELECT task, kind, id, label, {md5s} FROM ex"
    q["raw_tsv_counts"] = with_(EX) + "SELECT task, kind, count(*)::BIGINT AS n FROM ex GROUP BY task, kind"
    q["header_tsv_splits"] = with_(*PREP) + f"SELECT task, id, label, split, {md5s} FROM splits"
    q["stream_scores"] = with_(VX) + """
SELECT vec_id, class_idx::BIGINT AS pred_idx FROM (
  SELECT vec_id, class_idx, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class_idx) AS rn FROM lin)
WHERE rn = 1"""
    q["written_splits"] = with_(*PREP) + """
SELECT task, id, label, split, length(text_a)::BIGINT AS len_a, md5(coalesce(text_a, '')) AS md5_a,
       md5(coalesce(text_b, '')) AS md5_b FROM splits"""


_BUILDERS = [_step1, _step2, _step3, _step4, _step5, _step5b, _step5c, _step6, _step7, _step9, _step10]
_sql_base = sql


def sql() -> dict[str, str]:  # noqa: F811
    q = _sql_base()
    for b in _BUILDERS:
        b(q)
    return q
