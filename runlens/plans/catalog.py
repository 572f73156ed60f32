"""Registered queries: name -> (Spark plan, DuckDB oracle SQL).

Each Spark query takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables.  Oracle SQL runs on DuckDB with the test tables registered
as views; keys whose semantics SQL cannot state are registered without SQL and
are checked against a brute-force restatement in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.letters import parse_letter
from ..operators import grading as G
from . import bindings as B
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


# --------------------------------------------------------------------------- #
# Multiple choice: P1 J1 J4 A1 A4 P2
# --------------------------------------------------------------------------- #
@register("mc_accuracy", f"""
WITH {O.MC_CTES},
m AS (SELECT n.task, n.run_id, n.gen, n.n_answers,
             CASE WHEN t.correct_answer IS NULL THEN NULL
                  ELSE {O.mc_status('n.model_answer', 't.correct_answer')} END AS status
      FROM mc_norm n LEFT JOIN truth_mc t ON n.task = t.task AND n.question_id = t.question_id),
c AS (SELECT task, run_id, gen,
             count(*) FILTER (WHERE status = 'correct') AS correct,
             count(*) FILTER (WHERE status = 'incorrect') AS incorrect,
             count(*) FILTER (WHERE status = 'invalid') AS invalid,
             count(*) FILTER (WHERE n_answers > 1) AS duplicate_ids
      FROM m GROUP BY task, run_id, gen),
tot AS (SELECT task, count(*) AS total_questions FROM truth_mc GROUP BY task)
SELECT c.task, c.run_id, c.gen,
       CAST(coalesce(tot.total_questions, 0) AS BIGINT) AS total_questions,
       CAST(correct AS BIGINT) AS correct, CAST(incorrect AS BIGINT) AS incorrect,
       CAST(coalesce(tot.total_questions, 0) - correct - incorrect - invalid AS BIGINT) AS missing,
       CAST(invalid AS BIGINT) AS invalid, CAST(duplicate_ids AS BIGINT) AS duplicate_ids,
       round(CASE WHEN correct + incorrect > 0 THEN correct / (correct + incorrect) ELSE 0.0 END, 6) AS accuracy,
       round(CASE WHEN correct + incorrect > 0 THEN correct / (correct + incorrect) ELSE 0.0 END * 100.0, 6)
         AS accuracy_percent
FROM c LEFT JOIN tot ON c.task = tot.task
""")
def mc_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summarize_mc(B.b_truth_mc(spark, sf_dir), B.b_answers_mc(spark, sf_dir))


@register("mc_details", f"""
WITH {O.MC_CTES},
gens AS (SELECT DISTINCT task, run_id, gen FROM answers_mc),
grid AS (SELECT g.task, g.run_id, g.gen, t.question_id, t.correct_answer, t.domain, t.subdomain
         FROM gens g JOIN truth_mc t ON g.task = t.task),
d AS (SELECT grid.*, coalesce(n.model_answer, '') AS model_answer
      FROM grid LEFT JOIN mc_norm n ON n.task = grid.task AND n.run_id = grid.run_id
           AND n.gen = grid.gen AND n.question_id = grid.question_id)
SELECT task, run_id, gen, question_id, correct_answer, model_answer, domain, subdomain,
       {O.mc_status('model_answer', 'correct_answer')} AS status,
       {O.mc_status('model_answer', 'correct_answer')} = 'correct' AS is_correct
FROM d
""")
def mc_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grade_mc(B.b_truth_mc(spark, sf_dir), B.b_answers_mc(spark, sf_dir))


@register("mc_domain_stats", f"""
WITH {O.MC_CTES},
gens AS (SELECT DISTINCT task, run_id, gen FROM answers_mc),
t AS (SELECT task, question_id, correct_answer, coalesce(nullif(domain, ''), 'Unknown') AS domain FROM truth_mc),
grid AS (SELECT g.task, g.run_id, g.gen, t.question_id, t.correct_answer, t.domain
         FROM gens g JOIN t ON g.task = t.task),
d AS (SELECT grid.*, coalesce(n.model_answer, '') AS model_answer
      FROM grid LEFT JOIN mc_norm n ON n.task = grid.task AND n.run_id = grid.run_id
           AND n.gen = grid.gen AND n.question_id = grid.question_id)
SELECT task, run_id, gen, domain, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE {O.mc_status('model_answer', 'correct_answer')} = 'correct') AS BIGINT) AS correct,
       round(count(*) FILTER (WHERE {O.mc_status('model_answer', 'correct_answer')} = 'correct') * 100.0 / count(*), 6)
         AS accuracy_percent
FROM d GROUP BY task, run_id, gen, domain
""")
def mc_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.domain_stats(B.b_truth_mc(spark, sf_dir), B.b_answers_mc(spark, sf_dir))


ANSWER_PATH = O.q("$.answer")


def _parse_letter_sql(raw: str) -> str:
    text = f"coalesce({raw}, '')"
    block = f"regexp_extract({text}, '(?s)\\{{.*\\}}', 0)"
    ok = f"(({block}) <> '' AND json_valid({block}) AND json_type({block}) = 'OBJECT')"
    akind = f"json_type({block}, '$.answer')"
    value = O.strip(f"json_extract_string({block}, {ANSWER_PATH})")
    ans = f"(CASE WHEN {akind} IS NULL THEN '' WHEN {akind} = 'VARCHAR' THEN upper({value}) ELSE '#' END)"
    whole = f"upper({O.strip(text)})"
    return f"""(CASE
      WHEN {ok} AND contains('ABCD', {ans}) THEN {ans}
      WHEN contains('ABCD', {whole}) THEN {whole}
      WHEN regexp_extract({whole}, 'ANSWER IS ([ABCD])', 1) <> '' THEN regexp_extract({whole}, 'ANSWER IS ([ABCD])', 1)
      WHEN regexp_extract({whole}, 'ANSWER: ([ABCD])', 1) <> '' THEN regexp_extract({whole}, 'ANSWER: ([ABCD])', 1)
      WHEN contains({whole}, 'A') THEN 'A' WHEN contains({whole}, 'B') THEN 'B'
      WHEN contains({whole}, 'C') THEN 'C' WHEN contains({whole}, 'D') THEN 'D' ELSE '' END)"""


@register("parse_letter", f"""
WITH {O.MC_CTES}
SELECT task, run_id, gen, question_id, pos, answer AS raw, {_parse_letter_sql('answer')} AS letter
FROM answers_mc
""")
def parse_letter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.b_answers_mc(spark, sf_dir)
    return a.select("task", "run_id", "gen", "question_id", "pos", F.col("answer").alias("raw"),
                    parse_letter(F.col("answer")).alias("letter"))


@register("parse_letter_docs", f"""
SELECT doc_id, {_parse_letter_sql('text')} AS letter, {O.norm_letter('text')} AS normalized FROM documents
""")
def parse_letter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 and P2 over whole documents read as raw model responses."""
    from ..functions.letters import normalize_letter

    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", parse_letter(F.col("text")).alias("letter"),
                    normalize_letter(F.col("text")).alias("normalized"))


# --------------------------------------------------------------------------- #
# Labels: J2 A2 A5 T-2 J5 J6
# --------------------------------------------------------------------------- #
def _label_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grade_label(B.b_truth_label(spark, sf_dir), B.b_answers_label(spark, sf_dir))


@register("label_accuracy", f"""
WITH {O.LABEL_CTES}
SELECT task, run_id, gen, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n_total
FROM label_merged GROUP BY task, run_id, gen
""")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summarize_label(_label_merged(spark, sf_dir))


@register("label_per_class", f"""
WITH {O.LABEL_CTES}
SELECT task, run_id, gen, label, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n
FROM label_merged GROUP BY task, run_id, gen, label
""")
def label_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.per_class(_label_merged(spark, sf_dir))


@register("label_worst_best", f"""
WITH {O.LABEL_CTES},
pc AS (SELECT task, run_id, gen, label, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy
       FROM label_merged GROUP BY task, run_id, gen, label),
r AS (SELECT *, row_number() OVER (PARTITION BY task, run_id, gen ORDER BY accuracy ASC, label ASC) AS wr,
                row_number() OVER (PARTITION BY task, run_id, gen ORDER BY accuracy DESC, label DESC) AS br
      FROM pc)
SELECT task, run_id, gen, 'worst' AS side, CAST(wr AS INTEGER) AS rank, label, accuracy FROM r WHERE wr <= 10
UNION ALL
SELECT task, run_id, gen, 'best' AS side, CAST(br AS INTEGER) AS rank, label, accuracy FROM r WHERE br <= 10
""")
def label_worst_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.worst_best(G.per_class(_label_merged(spark, sf_dir)))


@register("label_missing_ids", f"""
WITH {O.LABEL_CTES}
SELECT g.task, g.run_id, g.gen, t.id
FROM label_gens g JOIN truth_label t ON g.task = t.task
WHERE NOT EXISTS (SELECT 1 FROM answers_label a
                  WHERE a.task = g.task AND a.run_id = g.run_id AND a.gen = g.gen AND a.id = t.id)
""")
def label_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_ids(B.b_truth_label(spark, sf_dir), B.b_answers_label(spark, sf_dir))


@register("label_invalid", f"""
WITH {O.LABEL_CTES}
SELECT a.task, a.run_id, a.gen, a.id, a.pred_label
FROM answers_label a
WHERE NOT EXISTS (SELECT 1 FROM label_classes c WHERE c.task = a.task AND c.label = a.pred_label)
""")
def label_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.invalid_labels(B.b_answers_label(spark, sf_dir), B.b_label_classes(spark, sf_dir))


# --------------------------------------------------------------------------- #
# Open answers: P3 P19 J3 A3
# --------------------------------------------------------------------------- #
@register("open_accuracy", f"""
WITH {O.OPEN_CTES}
SELECT task, run_id, gen, CAST(count(*) AS BIGINT) AS total_questions,
       CAST(count(*) FILTER (WHERE status = 'CORRECT') AS BIGINT) AS correct,
       CAST(count(*) FILTER (WHERE status = 'WRONG') AS BIGINT) AS wrong_answer,
       CAST(count(*) FILTER (WHERE status = 'FAILED_INFERENCE') AS BIGINT) AS failed_inference,
       round(count(*) FILTER (WHERE status = 'CORRECT') * 100.0 / count(*), 6) AS accuracy_percent
FROM open_graded GROUP BY task, run_id, gen
""")
def open_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = G.grade_open(B.b_truth_open(spark, sf_dir), B.b_answers_open(spark, sf_dir))
    return G.summarize_open(graded)


@register("open_details", f"""
WITH {O.OPEN_CTES}
SELECT task, run_id, gen, question_id, status, status = 'CORRECT' AS correct FROM open_graded
""")
def open_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = G.grade_open(B.b_truth_open(spark, sf_dir), B.b_answers_open(spark, sf_dir))
    return graded.select("task", "run_id", "gen", "question_id", "status", "correct")


# Further registrations live in sibling modules (imported for their side effect).
from . import q_extra, q_history, q_metrics, q_traces, q_variant  # noqa: E402,F401
