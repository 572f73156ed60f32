"""DuckDB twins of the bindings and of every checked query.

Written independently of the Spark code (plain SQL over the same parquet
views); the only shared pieces are fixed values: the whitespace class and the
regexp patterns, which must be identical for the results to match.
"""

from __future__ import annotations

from ..functions.text import WS_BODY, WS_CLASS


def q(s: str) -> str:
    """Quote a SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + WS_CLASS + '+|' + WS_CLASS + '+\\z')}, '', 'g')"


NONE_TEXT = "None"  # str(None)


def norm_letter(expr: str) -> str:
    u = f"upper({strip(f'coalesce(CAST({expr} AS VARCHAR), {q(NONE_TEXT)})')})"
    return f"(CASE WHEN contains('ABCD', {u}) THEN {u} ELSE regexp_extract({u}, '[ABCD]', 0) END)"


# --------------------------------------------------------------------------- #
# Binding twins
# --------------------------------------------------------------------------- #
TRUTH_MC = """
SELECT d.lang AS task, d.doc_id AS question_id,
       substr('ABCD', CAST(d.doc_id % 4 + 1 AS INTEGER), 1) AS correct_answer,
       CASE WHEN l.toxic = 1 THEN '' ELSE d.source END AS domain,
       CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS subdomain
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

ANSWERS_MC = """
SELECT lang AS task, run_id, gen, doc_id AS question_id,
       substr(text, CAST(run_id * 7 + gen * 13 + 1 AS INTEGER), 6) AS answer, CAST(0 AS BIGINT) AS pos
FROM mc_fan
UNION ALL
SELECT lang AS task, run_id, gen, doc_id AS question_id,
       substr(text, CAST(run_id * 5 + gen * 11 + 3 AS INTEGER), 6) AS answer, CAST(1 AS BIGINT) AS pos
FROM mc_fan WHERE (doc_id + run_id) % 17 = 0
"""

MC_FAN = """
SELECT d.doc_id, d.text, d.lang, r.run_id, g.gen
FROM documents d, range(0, 5) r(run_id), range(1, 5) g(gen)
WHERE (d.doc_id + g.gen) % 11 <> 0
"""

MC_NORM = f"""
SELECT task, run_id, gen, question_id, {norm_letter('answer')} AS model_answer, n_answers
FROM (SELECT task, run_id, gen, question_id, arg_max(answer, pos) AS answer, count(*) AS n_answers
      FROM answers_mc GROUP BY task, run_id, gen, question_id)
"""


def mc_status(ans: str, correct: str) -> str:
    return (
        f"(CASE WHEN {ans} = '' THEN 'missing' WHEN NOT contains('ABCD', {ans}) THEN 'invalid' "
        f"WHEN {ans} = {correct} THEN 'correct' ELSE 'incorrect' END)"
    )


MC_CTES = f"""
mc_fan AS ({MC_FAN}),
truth_mc AS ({TRUTH_MC}),
answers_mc AS ({ANSWERS_MC}),
mc_norm AS ({MC_NORM})
"""

LABEL_CTES = """
truth_label AS (SELECT source AS task, doc_id AS id, lang AS label FROM documents),
label_base AS (
  SELECT d.source AS task, CAST(7 AS BIGINT) AS run_id, g.gen, d.doc_id AS id,
         CASE WHEN (d.doc_id + g.gen) % 7 = 0 THEN 'xx'
              WHEN (d.doc_id * g.gen) % 3 = 0 THEN 'en' ELSE d.lang END AS pred_label
  FROM documents d, range(1, 3) g(gen)
  WHERE (d.doc_id + g.gen) % 13 <> 0),
answers_label AS (
  SELECT * FROM label_base
  UNION ALL SELECT task, run_id, gen, id, 'fr' AS pred_label FROM label_base WHERE id % 50 = 0),
label_gens AS (SELECT DISTINCT task, run_id, gen FROM answers_label),
label_merged AS (
  SELECT g.task, g.run_id, g.gen, t.id, t.label, coalesce(a.pred_label, '__missing__') AS pred_label,
         coalesce(a.pred_label, '__missing__') = t.label AS ok
  FROM label_gens g JOIN truth_label t ON g.task = t.task
  LEFT JOIN answers_label a ON a.task = g.task AND a.run_id = g.run_id AND a.gen = g.gen AND a.id = t.id),
label_classes AS (SELECT DISTINCT task, label FROM truth_label)
"""

LIST_ITEM = "[\"']?([^,\\[\\]\"'" + WS_BODY + "]+)[\"']?"
INT_TEXT = "^" + WS_CLASS + "*[+-]?[0-9]+(_[0-9]+)*" + WS_CLASS + "*\\z"


def _canonical_int(expr: str) -> str:
    sign = f"regexp_extract({expr}, {q('^' + WS_CLASS + '*([+-]?)')}, 1)"
    digits = f"regexp_replace(regexp_extract({expr}, '([0-9][0-9_]*)', 1), '_', '', 'g')"
    digits = f"coalesce(nullif(regexp_replace({digits}, '^0+', ''), ''), '0')"
    return f"(CASE WHEN {digits} = '0' THEN '0' ELSE (CASE WHEN {sign} = '-' THEN '-' ELSE '' END) || {digits} END)"


OPEN_CTES = f"""
truth_open AS (
  SELECT lang AS task, CAST(doc_id AS VARCHAR) AS question_id,
         CASE WHEN doc_id % 5 = 4 THEN 'list' ELSE 'str' END AS e_kind,
         CASE WHEN doc_id % 5 = 4 AND doc_id % 10 = 9 THEN ['a', 'a', 'b']
              WHEN doc_id % 5 = 4 THEN ['b', 'a'] END AS e_list,
         CASE WHEN doc_id % 5 <> 4 THEN CAST(n_chars AS VARCHAR) END AS e_scalar
  FROM documents),
resp_base AS (
  SELECT lang AS task, CAST(1 AS BIGINT) AS run_id, CAST(doc_id % 3 + 1 AS BIGINT) AS gen,
         CAST(doc_id AS VARCHAR) AS question_id,
         text || chr(10) ||
         CASE doc_id % 5 WHEN 0 THEN ''
              WHEN 1 THEN 'solution = ' || CAST(n_chars AS VARCHAR)
              WHEN 2 THEN 'solution = "' || CAST(n_chars AS VARCHAR) || '"'
              WHEN 3 THEN 'Solution= ' || CAST(n_chars + 1 AS VARCHAR)
              ELSE CASE WHEN doc_id % 10 = 9 THEN 'solution = [''a'', ''b'', ''b'']'
                        ELSE 'solution = [''a'', ''b'']' END END AS model_response
  FROM documents),
responses_open AS (
  SELECT * FROM resp_base
  UNION ALL SELECT task, run_id, gen, 'x' || question_id, model_response FROM resp_base
  WHERE CAST(question_id AS BIGINT) % 50 = 0),
open_found AS (
  SELECT *, regexp_extract(model_response,
           {q('(?i)solution' + WS_CLASS + '*=' + WS_CLASS + '*(.+?)(?:' + chr(10) + '|$)')}, 1) AS found
  FROM responses_open),
open_s AS (SELECT *, {strip('found')} AS s FROM open_found),
open_q AS (SELECT *, regexp_replace(s, {q("^[\"']+|[\"']+\\z")}, '', 'g') AS sq,
                 replace(s, '''', '"') AS sj FROM open_s),
answers_open AS (
  SELECT task, run_id, gen, question_id,
         CASE WHEN found = '' THEN NULL WHEN starts_with(s, '[') THEN 'list'
              WHEN regexp_matches(sq, {q(INT_TEXT)}) THEN 'int' ELSE 'str' END AS p_kind,
         CASE WHEN found <> '' AND starts_with(s, '[') THEN
              CASE WHEN json_valid(sj) AND json_type(sj) = 'ARRAY'
                   THEN list_transform(CAST(from_json(sj, '["JSON"]') AS JSON[]), lambda x:
                                       {strip("CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE CAST(x AS VARCHAR) END")})
                   ELSE regexp_extract_all(s, {q(LIST_ITEM)}, 1) END END AS p_list,
         CASE WHEN found = '' OR starts_with(s, '[') THEN NULL
              WHEN regexp_matches(sq, {q(INT_TEXT)}) THEN {_canonical_int('sq')} ELSE sq END AS p_scalar
  FROM open_q),
open_graded AS (
  SELECT a.task, a.run_id, a.gen, a.question_id,
         CASE WHEN a.p_kind IS NULL THEN 'FAILED_INFERENCE'
              WHEN t.e_kind IS NULL THEN 'WRONG'
              WHEN a.p_kind = 'list' AND t.e_kind = 'list' THEN
                   CASE WHEN len(a.p_list) = len(t.e_list) AND (a.p_list = t.e_list OR
                        list_sort(list_distinct(a.p_list)) = list_sort(list_distinct(t.e_list)))
                        THEN 'CORRECT' ELSE 'WRONG' END
              WHEN a.p_kind IN ('str', 'int') AND t.e_kind IN ('str', 'int') THEN
                   CASE WHEN {strip('a.p_scalar')} = {strip('t.e_scalar')} THEN 'CORRECT' ELSE 'WRONG' END
              ELSE 'WRONG' END AS status
  FROM answers_open a LEFT JOIN truth_open t ON a.task = t.task AND a.question_id = t.question_id)
"""
