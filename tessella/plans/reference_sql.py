"""SQL of the pipeline's queries, for an engine beside Spark."""

from __future__ import annotations

RENDER = """
parts AS (
  SELECT ord, id, coalesce(q_type, '') AS qt, coalesce(question.stem, '') AS stem, coalesce(answer_key, '') AS ans,
    [coalesce(c.label, '') || ') ' || coalesce(c.text, '') FOR c IN coalesce(question.choices, []) IF c IS NOT NULL] AS lines
  FROM questions
), bodies AS (
  SELECT *, CASE WHEN qt = 'Multiple Choice' AND len(lines) > 0 THEN stem || chr(10) || array_to_string(lines, chr(10)) ELSE stem END AS body FROM parts
), rendered AS (
  SELECT *, body || CASE WHEN ans <> '' THEN chr(10) || 'Answer: ' || ans ELSE '' END AS txt,
    'Exercise 1:' || CASE WHEN qt <> '' THEN chr(10) || qt || ':' ELSE '' END AS h1,
    'Exercise 2:' || CASE WHEN qt <> '' THEN chr(10) || qt || ':' ELSE '' END AS h2
  FROM bodies
)
"""
LM = f"""
WITH {RENDER}, words AS MATERIALIZED (
  SELECT ord, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+')) AS w FROM rendered
), tf AS MATERIALIZED (
  SELECT ord, w, count(*) AS tf FROM words GROUP BY 1, 2
), lens AS MATERIALIZED (
  SELECT ord, sum(tf) AS len FROM tf GROUP BY 1
), cf AS MATERIALIZED (
  SELECT w, sum(tf) AS cf FROM tf GROUP BY 1
), tot AS MATERIALIZED (
  SELECT sum(cf) AS total FROM cf
), marg AS MATERIALIZED (
  SELECT r.ord, coalesce(sum(tf.tf * ln(cf.cf / tot.total)), 0.0) AS logp, coalesce(any_value(lens.len), 0) AS len
  FROM rendered r LEFT JOIN tf ON tf.ord = r.ord LEFT JOIN cf ON cf.w = tf.w LEFT JOIN lens ON lens.ord = r.ord CROSS JOIN tot GROUP BY r.ord
), shared AS MATERIALIZED (
  SELECT a.ord AS c, b.ord AS o, sum(b.tf * ln(1 + 0.5 * (a.tf / la.len) / (0.5 * cf.cf / tot.total))) AS gain
  FROM tf a JOIN tf b ON a.w = b.w JOIN lens la ON la.ord = a.ord JOIN cf ON cf.w = a.w CROSS JOIN tot GROUP BY 1, 2
), scores AS MATERIALIZED (
  SELECT CAST(NULL AS BIGINT) AS cond_ord, ord, logp FROM marg
  UNION ALL
  SELECT a.ord, b.ord, b.logp + b.len * ln(0.5) + coalesce(s.gain, 0.0) FROM marg a CROSS JOIN marg b LEFT JOIN shared s ON s.c = a.ord AND s.o = b.ord
), soft AS MATERIALIZED (
  SELECT cond_ord, ord, logp - m - ln(sum(exp(logp - m)) OVER (PARTITION BY cond_ord)) AS logp
  FROM (SELECT *, max(logp) OVER (PARTITION BY cond_ord) AS m FROM scores)
), pmi AS MATERIALIZED (
  SELECT g.ord AS i, g.cond_ord AS k, g.logp - a.logp AS s FROM soft g JOIN soft a ON a.cond_ord IS NULL AND a.ord = g.ord WHERE g.cond_ord IS NOT NULL
)
"""
SIM = """
WITH v AS (SELECT ord, CAST(embedding AS DOUBLE[]) AS e FROM question_vecs WHERE embedding IS NOT NULL),
n AS (SELECT ord, e, sqrt(list_inner_product(e, e)) AS m FROM v),
sim AS (
  SELECT a.ord AS i, b.ord AS k, CASE WHEN a.m = 0 OR b.m = 0 THEN -1.0 ELSE least(1.0, greatest(-1.0, list_inner_product(a.e, b.e) / (a.m * b.m))) - 1.0 END AS s FROM n a CROSS JOIN n b
), rsim AS (SELECT i, k, round(s, 9) AS s FROM sim)
"""
NA = "('', ' ', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
TEMPLATE = f"""
t AS (
  SELECT row_id, problem_hierarchy, problem_name, step_name, CASE WHEN kc_lo NOT IN {NA} THEN kc_lo END AS lo, CASE WHEN kc_topic NOT IN {NA} THEN kc_topic END AS topic,
    step_name IS NOT NULL AND trim(step_name) <> '' AS has_unique
  FROM kc_template
), labelled AS (
  SELECT q.ord, q.ds_step_name, k.kc, k.kc_raw FROM questions q JOIN kc_table k ON k.ord = q.ord
), step_kc AS (
  SELECT step_name, arg_max(kc, (ord, pos)) AS label FROM (SELECT ord, kc, unnest(ds_step_name) AS step_name, generate_subscripts(ds_step_name, 1) AS pos FROM labelled WHERE kc IS NOT NULL) GROUP BY 1
), step_raw AS (
  SELECT step_name, arg_max(kc_raw, (ord, pos)) AS label FROM (SELECT ord, kc_raw, unnest(ds_step_name) AS step_name, generate_subscripts(ds_step_name, 1) AS pos FROM labelled WHERE kc_raw IS NOT NULL) GROUP BY 1
)
"""
UNIQUE = f"""
WITH {TEMPLATE}, u0 AS (SELECT row_id, translate(problem_hierarchy, '()', '') AS problem_hierarchy, problem_name, step_name, lo, topic FROM t),
u AS (
  SELECT problem_hierarchy, problem_name, step_name, arg_min(struct_pack(lo := lo, topic := topic), row_id) AS x FROM u0 GROUP BY 1, 2, 3
), log AS (
  SELECT row_id, anon_student_id, translate(problem_hierarchy, '()', '') AS problem_hierarchy, problem_name, step_name, first_transaction_time, first_attempt FROM student_step
), merged AS (
  SELECT l.*, u.x.lo AS kc_lo, u.x.topic AS kc_topic FROM log l LEFT JOIN u
    ON l.problem_hierarchy IS NOT DISTINCT FROM u.problem_hierarchy AND l.problem_name IS NOT DISTINCT FROM u.problem_name AND l.step_name IS NOT DISTINCT FROM u.step_name
), counted AS (
  SELECT *, CASE WHEN kc_lo IS NOT NULL THEN row_number() OVER (PARTITION BY anon_student_id, kc_lo ORDER BY row_id) END AS opp_lo,
    CASE WHEN kc_topic IS NOT NULL THEN row_number() OVER (PARTITION BY anon_student_id, kc_topic ORDER BY row_id) END AS opp_topic
  FROM merged
)
"""


def _codes(source: str, column: str, prefix: str, name: str) -> str:
    return f"{name} AS (SELECT v, '{prefix}-' || (row_number() OVER (ORDER BY v NULLS LAST) - 1) AS c FROM (SELECT DISTINCT {column} AS v FROM {source}))"


def _measures(pairs: str) -> str:
    return f"""
WITH {pairs}, cells AS (
  SELECT model, coalesce("true", 'nan') AS t, pred AS p, count(*)::DOUBLE AS n FROM pairs WHERE pred IS NOT NULL GROUP BY 1, 2, 3
), tot AS (SELECT model, sum(n) AS nn, sum(n * n) AS q FROM cells GROUP BY 1),
rowsum AS (SELECT model, t, sum(n) AS a FROM cells GROUP BY 1, 2),
colsum AS (SELECT model, p, sum(n) AS b FROM cells GROUP BY 1, 2),
ra AS (SELECT model, sum(a * a) AS aa, sum(-a / nn * ln(a / nn)) AS hc FROM rowsum JOIN tot USING (model) GROUP BY 1),
cb AS (SELECT model, sum(b * b) AS bb, sum(-b / nn * ln(b / nn)) AS hk, count(*) AS n_labels FROM colsum JOIN tot USING (model) GROUP BY 1),
info AS (SELECT model, sum(n / nn * ln(n * nn / (a * b))) AS mi FROM cells JOIN rowsum USING (model, t) JOIN colsum USING (model, p) JOIN tot USING (model) GROUP BY 1),
sizes AS (
  SELECT model, a, b, ta * tb AS times, nn FROM (SELECT model, a, count(*) AS ta FROM rowsum GROUP BY 1, 2) JOIN (SELECT model, b, count(*) AS tb FROM colsum GROUP BY 1, 2) USING (model) JOIN tot USING (model)
), terms AS (
  SELECT model, a, b, nn, times, unnest(range(greatest(1, a + b - nn)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM sizes
), emi AS (
  SELECT model, sum(times * k / nn * ln(nn * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(nn - a + 1) + lgamma(nn - b + 1) - lgamma(nn + 1)
    - lgamma(k + 1.0) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(nn - a - b + k + 1))) AS e FROM terms GROUP BY 1
), c AS (
  SELECT *, q - nn AS c11, bb - q AS c01, aa - q AS c10, nn * nn - aa - bb + q AS c00, (hc + hk) / 2 AS mean FROM tot JOIN ra USING (model) JOIN cb USING (model) JOIN info USING (model) JOIN emi USING (model)
), d AS (
  SELECT *, CASE WHEN hc = 0 THEN 1.0 ELSE mi / hc END AS h, CASE WHEN hk = 0 THEN 1.0 ELSE mi / hk END AS co FROM c
)
SELECT model, n_labels,
  round(CASE WHEN nn < 2 THEN 1.0 ELSE (c00 + c11) / (nn * nn - nn) END, 6) AS rand,
  round(CASE WHEN c01 = 0 AND c10 = 0 THEN 1.0 ELSE 2 * (c00 * c11 - c01 * c10) / ((c00 + c01) * (c01 + c11) + (c00 + c10) * (c10 + c11)) END, 6) AS adjusted_rand,
  round(CASE WHEN hc = 0 AND hk = 0 THEN 1.0 ELSE mi / mean END, 6) AS nmi,
  round(CASE WHEN hc = 0 AND hk = 0 THEN 1.0 ELSE (mi - e) / (mean - e) END, 6) AS ami,
  round(CASE WHEN nn < 2 THEN 1.0 WHEN c11 = 0 THEN 0.0 ELSE c11 / sqrt((aa - nn) * (bb - nn)) END, 6) AS fowlkes_mallows,
  round(h, 6) AS homogeneity, round(co, 6) AS completeness, round(CASE WHEN h + co = 0 THEN 0.0 ELSE 2 * h * co / (h + co) END, 6) AS v_measure
FROM d
"""


PAIRS = """
rows_ AS (SELECT q.skill, k.kc, q.topic, q.q_type FROM questions q JOIN kc_table k ON k.ord = q.ord),
pairs AS (
  SELECT 'kc' AS model, skill AS "true", kc AS pred FROM rows_ UNION ALL SELECT 'topic', skill, topic FROM rows_ UNION ALL SELECT 'type', skill, q_type FROM rows_
)
"""
CV = """
WITH cv AS (
  SELECT l_returnflag AS model, CASE WHEN l_linestatus = 'O' THEN 'aic' ELSE 'rmse' END AS metric, l_linenumber AS entry, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3
)
"""
FLAT = "flagged AS (SELECT * FROM kc_values WHERE slope <= 0.001 AND intercept_prob BETWEEN 0.2 AND 0.8)"
PHRASE = """
key_df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
phrases AS (
  SELECT r.ord, coalesce(best.w, '') AS concept FROM rendered r LEFT JOIN (
    SELECT ord, w FROM (
      SELECT tf.ord, tf.w, row_number() OVER (PARTITION BY tf.ord ORDER BY round(tf.tf * ln((SELECT count(*) FROM rendered) / df), 9) DESC, tf.w) AS rn FROM tf JOIN key_df USING (w)
    ) WHERE rn = 1
  ) best ON best.ord = r.ord
)
"""
NEXT = """, asked AS (
  SELECT ord, unnest(regexp_extract_all(lower(question.stem), '[\\p{L}\\p{N}]+')) AS w FROM questions
), own AS (
  SELECT ord, w, count(*) AS n FROM asked GROUP BY 1, 2
), held AS (
  SELECT ord, count(*) AS n FROM asked GROUP BY 1
), follow AS (
  SELECT q.ord, cf.w, ln(0.5 * coalesce(own.n / held.n, 0) + 0.5 * cf.cf / tot.total) AS logp
  FROM questions q CROSS JOIN cf CROSS JOIN tot LEFT JOIN held ON held.ord = q.ord LEFT JOIN own ON own.ord = q.ord AND own.w = cf.w
)
"""
MEMBERS = f"""
{FLAT}, asked AS (
  SELECT DISTINCT t.lo AS kc_name, q.ord FROM t JOIN flagged f ON f.kc_name = t.lo JOIN (SELECT ord, unnest(ds_step_name) AS step_name FROM questions) q ON q.step_name = t.step_name
), members AS (SELECT kc_name, ord FROM asked WHERE kc_name IN (SELECT kc_name FROM asked GROUP BY 1 HAVING count(*) >= 3))
"""

SQL = {
    "question_render": f"WITH {RENDER} SELECT ord, qt AS q_type, h1 AS header, body, ans AS answer, h1 || chr(10) || body || chr(10) || 'Answer:' AS prompt, txt AS rendered FROM rendered",
    "question_flat": f"""WITH {RENDER} SELECT q.ord, q.id, q.q_type, r.txt AS question, q.answer_key, array_to_string(q.skillref, '~') AS skillref, array_to_string(q.step_name, '~') AS step_name,
      array_to_string(q.ds_step_name, '~') AS ds_step_name, q.skill, q.subject, q.topic, q.category, q.grade FROM questions q JOIN rendered r ON r.ord = q.ord""",
    "concept_prompt": f"""WITH {RENDER}, p AS (SELECT ord, h1 || chr(10) || txt || chr(10) || chr(10) || 'Remark:' || chr(10) || 'The above exercise is a ' || replace(lower(qt), ' ', '-') || ' question that tests ' AS p FROM rendered)
      SELECT ord, p || 'whether the student understands the concept of' AS noun, p || 'whether the student can' AS verb FROM p""",
    "concept_clean": "SELECT ord, rtrim(regexp_replace(' ' || kc || ' ., ', '^\\s+|\\s+$', '', 'g'), '.,') AS concept FROM kc_table",
    "concept_invalid": "SELECT ord FROM kc_table WHERE coalesce(trim(kc), '') = ''",
    "pair_prompts": f"""WITH {RENDER} SELECT CAST(NULL AS BIGINT) AS cond_ord, ord, length(h2 || chr(10)) AS context_len, md5(h2 || chr(10) || txt) AS digest FROM rendered
      UNION ALL SELECT a.ord, b.ord, length(a.h1 || chr(10) || a.txt || chr(10) || chr(10) || b.h2 || chr(10)), md5(a.h1 || chr(10) || a.txt || chr(10) || chr(10) || b.h2 || chr(10) || b.txt) FROM rendered a CROSS JOIN rendered b""",
    "skill_histogram": "SELECT skill, count(*) AS n FROM questions GROUP BY 1",
    "skill_filter": """WITH k AS (SELECT ord, skill FROM questions WHERE len(question.choices) >= 2), s AS (SELECT skill FROM k GROUP BY 1 HAVING count(*) >= 10)
      SELECT k.ord, k.skill FROM k JOIN s ON k.skill IS NOT DISTINCT FROM s.skill""",
    "fold_identical": f"""WITH {RENDER}, f AS (SELECT r.txt, r.ord, coalesce(q.step_name, []) AS s FROM rendered r JOIN questions q ON q.ord = r.ord)
      SELECT min(ord) AS ord, count(*) AS n_copies, array_to_string(flatten(list(s ORDER BY ord)), '~') AS steps FROM f GROUP BY txt""",
    "fold_members": f"""WITH {RENDER}, f AS (SELECT r.txt, r.ord, q.step_name AS s FROM rendered r JOIN questions q ON q.ord = r.ord), g AS (SELECT txt, min(ord) AS ord, count(*) AS n_copies FROM f GROUP BY 1)
      SELECT g.ord, n_copies, f.ord AS copy_ord, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS step FROM f JOIN g USING (txt) WHERE len(s) > 0
      UNION ALL SELECT g.ord, n_copies, f.ord, -1, NULL FROM f JOIN g USING (txt) WHERE coalesce(len(s), 0) = 0""",
    "lm_marginals": LM + "SELECT ord, round(logp, 4) AS logp FROM marg",
    "lm_logprob": LM + "SELECT cond_ord, ord, round(logp, 4) AS logp FROM scores",
    "lm_holes": "SELECT n * n + n AS expected, n * n + n AS present, n * n + n AS n_rows, CAST(0 AS BIGINT) AS not_finite FROM (SELECT count(*) AS n FROM questions)",
    "pmi_raw": LM + "SELECT g.ord AS i, g.cond_ord AS k, round(g.logp - a.logp, 4) AS s FROM scores g JOIN marg a ON a.ord = g.ord WHERE g.cond_ord IS NOT NULL",
    "pmi_normalized": LM + "SELECT a.i, a.k, round((a.s + b.s) / 2, 4) AS s FROM pmi a JOIN pmi b ON a.i = b.k AND a.k = b.i",
    "pmi_conditionals": LM + "SELECT p.i, p.k, round(p.s + a.logp, 4) AS logp FROM pmi p JOIN soft a ON a.cond_ord IS NULL AND a.ord = p.i",
    "key_phrases": LM + f", {PHRASE} SELECT ord, concept FROM phrases",
    "key_phrases_verbal": LM
    + f""", {PHRASE}, toks AS (SELECT ord, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+') AS ws FROM rendered), placed AS (SELECT p.ord, p.concept, t.ws, list_position(t.ws, p.concept) AS i FROM phrases p JOIN toks t USING (ord))
      SELECT ord, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || concept ELSE concept END AS concept FROM placed""",
    "pmi_subset": LM + """, m AS (SELECT ord FROM questions WHERE q_type = 'Short Answer')
      SELECT a.i, a.k, round((a.s + b.s) / 2, 4) AS s FROM pmi a JOIN pmi b ON a.i = b.k AND a.k = b.i WHERE a.i IN (SELECT ord FROM m) AND a.k IN (SELECT ord FROM m)""",
    "next_words": LM + NEXT + "SELECT ord, rank, w, round(logp, 6) AS logp FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(logp, 12) DESC, w) AS rank FROM follow) WHERE rank <= 3",
    "next_choices": LM + NEXT + """, offered AS (SELECT DISTINCT ord, unnest(regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}]+')) AS w FROM (SELECT ord, unnest(question.choices) AS c FROM questions))
      SELECT ord, rank, w, round(logp, 6) AS logp FROM (SELECT f.*, row_number() OVER (PARTITION BY ord ORDER BY round(logp, 12) DESC, w) AS rank FROM follow f JOIN offered USING (ord, w)) WHERE rank <= 1""",
    "next_word_logits": LM + NEXT + "SELECT ord, w, round(logp, 6) AS logp FROM follow WHERE w IN ('the', 'of', 'is', 'which', 'nosuchword')",
    "text_vectors": LM + """, slots AS (SELECT t.ord, CAST('0x' || substr(md5(t.w), 1, 8) AS BIGINT) % 64 AS slot, sum(CASE WHEN CAST('0x' || substr(md5(t.w), 9, 1) AS BIGINT) % 2 = 1 THEN -t.tf ELSE t.tf END) AS v, any_value(l.len) AS len
        FROM tf t JOIN lens l USING (ord) GROUP BY 1, 2) SELECT ord, slot, round(CAST(CAST(v / len AS FLOAT) AS DOUBLE), 5) AS v FROM slots WHERE v <> 0""",
    "sim_cosine": SIM + "SELECT i, k, round(s, 5) AS s FROM sim",
    "sim_euclidean": SIM + "SELECT a.ord AS i, b.ord AS k, round(-sqrt(greatest(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 0)), 5) AS s FROM n a CROSS JOIN n b",
    "preferences": SIM + "SELECT round(median(s), 6) AS p_median, round(avg(s), 6) AS p_mean, round(min(s), 6) AS p_min, round(max(s), 6) AS p_max FROM sim WHERE i <> k",
    "subset_similarity": SIM + """, m AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS x FROM v WHERE ord IN (SELECT ord FROM questions WHERE q_type = 'Short Answer'))
      SELECT a.x AS a, b.x AS b, round(s, 5) AS s FROM sim JOIN m a ON a.ord = i JOIN m b ON b.ord = k""",
    "ap_step": SIM + """, p AS (SELECT i, k, CASE WHEN i = k THEN -1.0 ELSE s END AS s FROM sim), r1 AS (
        SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, k) AS rn FROM p
      ), r2 AS (SELECT *, max(CASE WHEN rn = 1 THEN s END) OVER (PARTITION BY i) AS top, max(CASE WHEN rn = 2 THEN s END) OVER (PARTITION BY i) AS second FROM r1),
      r AS (SELECT i, k, 0.5 * (s - CASE WHEN rn = 1 THEN second ELSE top END) AS r FROM r2),
      kept AS (SELECT *, CASE WHEN i = k THEN r ELSE greatest(r, 0) END AS kept FROM r),
      summed AS (SELECT *, sum(kept) OVER (PARTITION BY k) - kept AS rest FROM kept)
      SELECT i, k, round(r, 5) AS r, round(0.5 * CASE WHEN i = k THEN rest ELSE least(0, rest) END, 4) AS a FROM summed""",
    "exemplar_assign": SIM + """, ex AS (SELECT DISTINCT CAST(split_part(kc_raw, '-', 2) AS BIGINT) AS k FROM kc_table WHERE kc_raw IS NOT NULL)
      SELECT i AS ord, k AS exemplar FROM (SELECT i, k, row_number() OVER (PARTITION BY i ORDER BY i = k DESC, s DESC, k) AS rn FROM rsim JOIN ex USING (k)) WHERE rn = 1""",
    "exemplar_label": "SELECT a.ord, 'KC-' || b.ord AS \"KC-raw\", b.kc AS \"KC\" FROM kc_table a JOIN kc_table b ON b.ord = TRY_CAST(split_part(a.kc_raw, '-', 2) AS BIGINT)",
    "contingency": f"WITH {PAIRS} SELECT model, coalesce(\"true\", 'nan') AS \"true\", pred, count(*) AS n FROM pairs WHERE pred IS NOT NULL GROUP BY 1, 2, 3",
    "metrics_all": _measures(PAIRS),
    "template_metrics": _measures(TEMPLATE + """, pairs AS (SELECT 'lo' AS model, topic AS "true", lo AS pred FROM t UNION ALL SELECT 'problem', topic, problem_name FROM t)"""),
    "label_counts": f"WITH {PAIRS} SELECT model, count(DISTINCT pred) AS n_labels FROM pairs GROUP BY 1",
    "cv_table": CV + "SELECT model, metric, 'mean' AS run, round(avg(value), 4) AS value FROM cv WHERE metric = 'aic' GROUP BY 1, 2 UNION ALL SELECT model, metric, CAST(entry AS VARCHAR), round(value, 4) FROM cv WHERE metric <> 'aic'",
    "cv_publication": CV + "SELECT model, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM cv GROUP BY 1, 2",
    "cv_runs": CV + "SELECT model, metric, count(*) AS n FROM cv GROUP BY 1, 2 HAVING count(*) <> 10",
    "step_to_kc": f"WITH {TEMPLATE} SELECT step_name, label FROM step_kc",
    "kc_template_fill": f"""WITH {TEMPLATE} SELECT t.row_id, problem_hierarchy, problem_name, t.step_name, CASE WHEN lo IS NOT NULL AND topic IS NOT NULL AND has_unique THEN s.label END AS "KC (new)"
      FROM t LEFT JOIN step_kc s ON s.step_name = t.step_name""",
    "kc_template_models": f"""WITH {TEMPLATE}, one AS (SELECT t.*, CASE WHEN lo IS NOT NULL AND topic IS NOT NULL AND has_unique THEN s.label END AS kc FROM t LEFT JOIN step_kc s ON s.step_name = t.step_name)
      SELECT row_id, problem_hierarchy, problem_name, o.step_name, lo AS "KC (lo)", topic AS "KC (topic)", kc AS "KC (kc)",
        CASE WHEN lo IS NOT NULL AND topic IS NOT NULL AND kc IS NOT NULL AND has_unique THEN s.label END AS "KC (raw)" FROM one o LEFT JOIN step_raw s ON s.step_name = o.step_name""",
    "kc_adjust": f"""WITH {TEMPLATE}, known AS (SELECT DISTINCT unnest(ds_step_name) AS step_name FROM questions), m AS (
        SELECT t.*, lo IS NOT NULL AND topic IS NOT NULL AND has_unique AND k.step_name IS NOT NULL AS ok FROM t LEFT JOIN known k ON k.step_name = t.step_name)
      SELECT row_id, problem_hierarchy, problem_name, step_name, CASE WHEN ok THEN lo END AS "KC (goal)", CASE WHEN ok THEN topic END AS "KC (topic-new)" FROM m""",
    "kc_long": f"WITH {TEMPLATE} SELECT row_id, 'lo' AS kc_model, lo AS kc_label FROM t UNION ALL SELECT row_id, 'topic', topic FROM t",
    "template_duplicates": "SELECT problem_hierarchy, problem_name, step_name, count(*) AS n FROM kc_template GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "clean_steps": f"""WITH {TEMPLATE}, r AS (SELECT step_name AS raw, min(row_id) AS first FROM t WHERE lo IS NOT NULL AND topic IS NOT NULL AND step_name IS NOT NULL GROUP BY 1)
      SELECT split_part(raw, ' ', 1) AS clean, string_agg(raw, '~' ORDER BY first) AS raw FROM r GROUP BY 1""",
    "question_steps": f"""WITH {TEMPLATE}, r AS (SELECT step_name AS raw, min(row_id) AS first FROM t WHERE lo IS NOT NULL AND topic IS NOT NULL AND step_name IS NOT NULL GROUP BY 1),
      cr AS (SELECT split_part(raw, ' ', 1) AS clean, string_agg(raw, '~' ORDER BY first) AS raws FROM r GROUP BY 1),
      qs AS (SELECT ord, unnest(step_name) AS s, generate_subscripts(step_name, 1) AS pos FROM questions)
      SELECT ord, string_agg(s, '~' ORDER BY pos) AS steps, string_agg(raws, '~' ORDER BY pos) AS raw_steps FROM qs JOIN cr ON cr.clean = qs.s GROUP BY 1""",
    "question_steps_part": f"""WITH {TEMPLATE}, t2 AS (SELECT row_id, 'q1 part ' || replace(split_part(step_name, ' ', 1), '_', '-') || ' UpdateComboBox' AS step_name, lo, topic FROM t),
      r AS (SELECT step_name AS raw, min(row_id) AS first FROM t2 WHERE lo IS NOT NULL AND topic IS NOT NULL AND step_name IS NOT NULL GROUP BY 1),
      cr AS (SELECT regexp_extract(raw, 'part (\\S+)', 1) AS clean, string_agg(raw, '~' ORDER BY first) AS raws FROM r GROUP BY 1),
      qs AS (SELECT ord, 'page_' || replace(unnest(step_name), '_', '-') AS s, generate_subscripts(step_name, 1) AS pos FROM questions)
      SELECT ord, string_agg(s, '~' ORDER BY pos) AS steps, string_agg(raws, '~' ORDER BY pos) AS raw_steps FROM qs JOIN cr ON cr.clean = split_part(qs.s, '_', -1) GROUP BY 1""",
    "kc_names": "SELECT column_name, regexp_extract(column_name, 'KC \\((.+?)(-\\d+)?\\)', 1) AS model FROM (SELECT 'KC (' || kc_name || '-' || n_steps || ')' AS column_name FROM kc_values)",
    "student_step_merge": UNIQUE + "SELECT * FROM counted",
    "student_step_minimal": UNIQUE
    + ", "
    + ", ".join(
        _codes(*x)
        for x in (
            ("merged", "anon_student_id", "ST", "st"),
            ("merged", "problem_hierarchy", "PH", "ph"),
            ("merged", "problem_name", "PN", "pn"),
            ("merged", "step_name", "SN", "sn"),
            ("(SELECT x.lo AS lo FROM u WHERE x.lo IS NOT NULL)", "lo", "KC", "kl"),
            ("(SELECT x.topic AS topic FROM u WHERE x.topic IS NOT NULL)", "topic", "KC", "kt"),
        )
    )
    + """ SELECT row_id, st.c AS anon_student_id, ph.c AS problem_hierarchy, pn.c AS problem_name, sn.c AS step_name, kl.c AS kc_lo, opp_lo, kt.c AS kc_topic_1, opp_topic AS opp_topic_1
      FROM counted m JOIN st ON st.v IS NOT DISTINCT FROM m.anon_student_id JOIN ph ON ph.v IS NOT DISTINCT FROM m.problem_hierarchy JOIN pn ON pn.v IS NOT DISTINCT FROM m.problem_name
      JOIN sn ON sn.v IS NOT DISTINCT FROM m.step_name LEFT JOIN kl ON kl.v = m.kc_lo LEFT JOIN kt ON kt.v = m.kc_topic""",
    "refine_candidates": f"WITH {FLAT} SELECT kc_name, n_steps FROM flagged",
    "refine_mismatch": f"WITH {TEMPLATE}, {FLAT} SELECT f.kc_name, f.n_steps, count(t.row_id) AS found FROM flagged f LEFT JOIN t ON t.lo = f.kc_name GROUP BY 1, 2 HAVING count(t.row_id) <> f.n_steps",
    "refine_pairs": SIM + f""", {TEMPLATE}, {MEMBERS} SELECT a.kc_name AS grp, i, k, round(s, 5) AS s FROM sim JOIN members a ON a.ord = i JOIN members b ON b.ord = k AND b.kc_name = a.kc_name""",
    "refine_questions": f"WITH {TEMPLATE}, {MEMBERS} SELECT kc_name, ord FROM members",
    "refine_relabel": LM
    + f""", {PHRASE}, {TEMPLATE}, {MEMBERS}, steps_ AS (
        SELECT m.kc_name, m.ord, p.concept, unnest(q.ds_step_name) AS step_name, generate_subscripts(q.ds_step_name, 1) AS pos FROM members m JOIN phrases p USING (ord) JOIN questions q USING (ord)
      ), labels AS (SELECT kc_name, step_name, arg_max(concept, (ord, pos)) AS label FROM steps_ GROUP BY 1, 2)
      SELECT t.row_id, 'cpt-' || d.kc_name AS kc_model, CASE WHEN t.lo = d.kc_name THEN l.label ELSE t.lo END AS kc_label
      FROM t CROSS JOIN (SELECT DISTINCT kc_name FROM labels) d LEFT JOIN labels l ON l.kc_name = d.kc_name AND l.step_name = t.step_name""",
}
