"""Registered trajectory, usage and reward queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.solution import extract_solution
from ..operators import containment as X
from ..operators import grading as G
from ..operators import rewards as R
from ..operators import trajectories as T
from ..operators import usage as U
from . import bindings as B
from .catalog import register
from ..functions.text import WS_CLASS
from .oracle import MC_CTES, OPEN_CTES, mc_status, q, strip

SOLUTION_FIELD = q("(?i)solution" + WS_CLASS + "*=")

RUN_GEN = ["run_id", "gen"]


@register("turn_counts", """
SELECT conv_id % 4 AS run_id, CAST(1 AS BIGINT) AS gen, conv_id AS question_id,
       CAST(count(*) FILTER (WHERE role = 'assistant' AND coalesce(length(text) > 0, false)) AS BIGINT)
         AS agent_turns,
       CAST(count(*) AS BIGINT) AS messages
FROM conversations GROUP BY conv_id
""")
def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.turn_counts(B.b_turns(spark, sf_dir), RUN_GEN + ["question_id"])


@register("first_trajectories", """
WITH t AS (SELECT conv_id % 4 AS run_id, CAST(1 AS BIGINT) AS gen, conv_id AS question_id, turn, role, text
           FROM conversations),
k AS (SELECT DISTINCT run_id, gen, question_id, 'execution_q' || CAST(question_id AS VARCHAR) || '.json' AS file_name
      FROM t),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, gen ORDER BY file_name) AS sample FROM k)
        WHERE sample <= 3),
tr AS (SELECT run_id, gen, question_id,
              string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript,
              CAST(count(*) AS BIGINT) AS messages
       FROM t WHERE (run_id, gen, question_id) IN (SELECT run_id, gen, question_id FROM top)
       GROUP BY run_id, gen, question_id)
SELECT top.run_id, top.gen, CAST(top.sample AS INTEGER) AS sample, top.question_id, top.file_name, tr.messages,
       CASE WHEN length(transcript) > 1000 THEN left(transcript, 1000) || chr(10) || '  ... (truncated)'
            ELSE transcript END AS preview
FROM top JOIN tr ON top.run_id = tr.run_id AND top.gen = tr.gen AND top.question_id = tr.question_id
""")
def first_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_trajectories(B.b_turns(spark, sf_dir), RUN_GEN, "question_id")


def _price_sql() -> str:
    rows = ", ".join(f"('{m}', CAST({pi} AS DECIMAL(12,4)), CAST({po} AS DECIMAL(12,4)))" for m, pi, po in B.PRICES)
    return f"prices(model, pi, po) AS (VALUES {rows})"


@register("usage_totals", f"""
WITH {_price_sql()},
c AS (SELECT l.l_suppkey AS run_id, CAST(l.l_quantity AS DECIMAL(20,2)) AS i,
             CAST(l.l_extendedprice AS DECIMAL(20,2)) AS o, CAST(l.l_linenumber AS DECIMAL(20,2)) AS r,
             l.l_linestatus = 'O' AS success,
             coalesce(p.pi, CAST(0 AS DECIMAL(12,4))) AS pi, coalesce(p.po, CAST(0 AS DECIMAL(12,4))) AS po
      FROM lineitem l LEFT JOIN prices p ON l.l_returnflag = p.model)
SELECT run_id, CAST(count(*) AS BIGINT) AS calls,
       CAST(count(*) FILTER (WHERE NOT coalesce(success, false)) AS BIGINT) AS errors,
       CAST(sum(i) AS DOUBLE) AS total_input_tokens, CAST(sum(o) AS DOUBLE) AS total_output_tokens,
       CAST(sum(r) AS DOUBLE) AS total_reasoning_tokens,
       round(CAST(sum(i * pi + (o + r) * po) AS DOUBLE) / 1000000.0, 6) AS total_cost_usd
FROM c GROUP BY run_id
""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.usage_totals(B.b_usage(spark, sf_dir), B.b_prices(spark), ["run_id"])


@register("group_advantage", f"""
WITH {MC_CTES},
g AS (SELECT DISTINCT task, run_id, gen FROM answers_mc),
grid AS (SELECT g.task, g.run_id, g.gen, t.question_id, t.correct_answer FROM g JOIN truth_mc t ON g.task = t.task),
d AS (SELECT grid.*, coalesce(n.model_answer, '') AS model_answer
      FROM grid LEFT JOIN mc_norm n ON n.task = grid.task AND n.run_id = grid.run_id
           AND n.gen = grid.gen AND n.question_id = grid.question_id),
r AS (SELECT task, run_id, gen, question_id,
             CASE WHEN {mc_status('model_answer', 'correct_answer')} = 'correct' THEN 1.0 ELSE 0.0 END AS reward
      FROM d)
SELECT task, run_id, gen, question_id, CAST(reward AS DOUBLE) AS reward,
       round(reward - avg(reward) OVER (PARTITION BY task, gen, question_id), 6) AS advantage
FROM r
""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = G.grade_mc(B.b_truth_mc(spark, sf_dir), B.b_answers_mc(spark, sf_dir))
    rollouts = details.select("task", "run_id", "gen", "question_id",
                              F.when(F.col("is_correct"), 1.0).otherwise(0.0).alias("reward"))
    return R.group_advantage(rollouts, ["task", "gen", "question_id"])


@register("episode_rewards", f"""
WITH {OPEN_CTES},
steps AS (SELECT CAST(conv_id AS VARCHAR) AS question_id,
                 CASE WHEN regexp_matches(text, {SOLUTION_FIELD})
                      THEN 0.5 ELSE -0.5 END - 0.01
                 + CASE WHEN contains(text, 'hallucinate') THEN -0.3 ELSE 0.0 END AS r
          FROM conversations WHERE role = 'assistant'),
agg AS (SELECT question_id, CAST(count(*) AS BIGINT) AS steps, sum(CAST(r AS DECIMAL(12,4))) AS s
        FROM steps GROUP BY question_id),
g AS (SELECT question_id, status = 'CORRECT' AS ok FROM open_graded)
SELECT agg.question_id, steps, round(CAST(s AS DOUBLE), 6) AS step_reward,
       CAST(CASE WHEN coalesce(g.ok, false) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS final_reward,
       round(CAST(s AS DOUBLE) + CASE WHEN coalesce(g.ok, false) THEN 1.0 ELSE 0.0 END, 6) AS total_reward
FROM agg LEFT JOIN g ON agg.question_id = g.question_id
""")
def episode_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = B.b_turns(spark, sf_dir).where(F.col("role") == "assistant")
    steps = turns.select(F.col("question_id").cast("string").alias("question_id"), "text")
    # Only episodes that exist need a grade: restrict responses before extracting solutions.
    wanted = steps.select("question_id").distinct()
    resp = B.b_responses_open(spark, sf_dir).join(wanted, "question_id", "left_semi")
    answers = resp.select("task", "run_id", "gen", "question_id",
                          extract_solution(F.col("model_response")).alias("solution"))
    graded = G.grade_open(B.b_truth_open(spark, sf_dir), answers)
    return R.episode_rewards(steps, graded.select("question_id", "correct"), ["question_id"])


@register("first_labels", """
SELECT source AS label, min(doc_id) AS first_pos FROM documents GROUP BY source ORDER BY first_pos LIMIT 10
""")
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    firsts = d.groupBy(F.col("source").alias("label")).agg(F.min("doc_id").alias("first_pos"))
    return firsts.orderBy("first_pos").limit(10)


@register("extract_label", f"""
WITH c AS (SELECT item_id AS pos, text AS label FROM benchmark),
d AS (SELECT doc_id, {strip('text')} AS t1 FROM documents),
d2 AS (SELECT doc_id, t1, {strip("replace(replace(replace(t1, '罪名：', ''), '[罪名]', ''), '罪', '')")} AS t2 FROM d),
p1 AS (SELECT d2.doc_id, min(c.pos) AS pos FROM d2 JOIN c ON contains(d2.t1, c.label) GROUP BY d2.doc_id),
p2 AS (SELECT d2.doc_id, min(c.pos) AS pos FROM d2 JOIN c ON contains(d2.t2, {strip("replace(c.label, '罪', '')")})
       GROUP BY d2.doc_id),
f AS (SELECT arg_min(label, pos) AS label, min(pos) AS pos FROM c),
best AS (SELECT d2.doc_id,
                CASE WHEN p1.pos IS NOT NULL THEN 1 WHEN p2.pos IS NOT NULL THEN 2 ELSE 0 END AS pass,
                coalesce(p1.pos, p2.pos, (SELECT pos FROM f)) AS pos
         FROM d2 LEFT JOIN p1 ON d2.doc_id = p1.doc_id LEFT JOIN p2 ON d2.doc_id = p2.doc_id)
SELECT best.doc_id, c.label, CAST(best.pass AS INTEGER) AS pass, CAST(best.pos AS BIGINT) AS pos
FROM best JOIN c ON best.pos = c.pos
""")
def extract_label_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.extract_label(docs, B.b_classes(spark, sf_dir), ["doc_id"])
