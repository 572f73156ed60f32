"""Registered queries: prompts, tails, inference summary, batches, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import prompts as P
from ..functions.text import tail_lines
from ..operators import grading as G
from ..operators import history as H
from ..operators import rewards as R
from ..operators import usage as U
from . import bindings as B
from .catalog import register
from .oracle import LABEL_CTES, q


@register("tail_lines", """
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents)
SELECT doc_id, CASE WHEN len(parts) > 10 THEN array_to_string(parts[len(parts) - 9:], chr(10)) ELSE text END AS tail
FROM s
""")
def tail_lines_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", tail_lines(F.col("text")).alias("tail"))


def _options():
    """Four options from the document's own fields."""
    values = [F.col("lang"), F.col("source"), F.col("n_chars").cast("string"), F.col("doc_id").cast("string")]
    return F.create_map(*[x for letter, v in zip("ABCD", values) for x in (F.lit(letter), v)])


@register("format_question", f"""
SELECT d.doc_id AS question_id,
       {q(P.MC_HEAD)} || d.text || chr(10) || chr(10)
       || 'A) ' || d.lang || chr(10) || 'B) ' || d.source || chr(10)
       || 'C) ' || CAST(d.n_chars AS VARCHAR) || chr(10) || 'D) ' || CAST(d.doc_id AS VARCHAR)
       || {q(P.MC_TAIL)} AS prompt
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")
def format_question_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = B.table(spark, sf_dir, "labels").select("doc_id")
    questions = labels.join(docs, "doc_id")
    return questions.select(F.col("doc_id").alias("question_id"),
                            P.format_question(F.col("text"), _options()).alias("prompt"))


@register("few_shot_prompt", f"""
WITH fl AS (SELECT source AS label, min(doc_id) AS first_pos FROM documents GROUP BY source
            ORDER BY first_pos LIMIT 10),
ex AS (SELECT CASE WHEN count(*) > 0 THEN {q(P.CASE_EXAMPLES_HEAD)}
                   || string_agg('- ' || label, chr(10) ORDER BY first_pos) || chr(10) ELSE '' END AS block FROM fl),
cl AS (SELECT string_agg(label, ', ' ORDER BY pos) AS classes FROM (
         SELECT item_id AS pos, text AS label FROM benchmark ORDER BY item_id LIMIT 20))
SELECT d.doc_id, {q(P.CASE_HEAD)} || ex.block || {q(P.CASE_FACTS)} || d.text || {q(P.CASE_CHOOSE)}
       || coalesce(cl.classes, '') || {q(P.CASE_TAIL)} AS prompt
FROM documents d, ex, cl
""")
def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 + A12: the sample labels and first classes are one-row scalar
    subqueries (bounded: 10 and 20 items), not a join."""
    d = B.table(spark, sf_dir, "documents")
    firsts = d.groupBy(F.col("source").alias("label")).agg(F.min("doc_id").alias("first_pos")) \
        .orderBy("first_pos").limit(C.FIRST_LABELS_N)
    labels = F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "label"))), lambda x: x["label"])
    examples = firsts.agg(P.examples_block(labels).alias("e")).scalar()
    classes = B.b_classes(spark, sf_dir).orderBy("pos").limit(C.FEW_SHOT_CLASSES_N)
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])
    class_list = classes.agg(P.classes_text(names).alias("c")).scalar()
    return d.select("doc_id", P.case_prompt(F.col("text"), examples, class_list).alias("prompt"))


@register("inference_summary", """
SELECT lang AS task, CAST(1 AS BIGINT) AS run_id, CAST(doc_id % 3 + 1 AS BIGINT) AS gen,
       CAST(count(*) AS BIGINT) AS total_questions,
       CAST(count(*) FILTER (WHERE doc_id % 5 <> 0) AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE doc_id % 5 = 0) AS BIGINT) AS failed,
       CAST(sum(n_chars) AS BIGINT) AS total_prompt_tokens,
       CAST(sum(length(text) // 7) AS BIGINT) AS total_completion_tokens,
       round(CAST(sum(CAST(n_chars AS DECIMAL(20,6)) / 1000) AS DOUBLE), 6) AS total_elapsed_seconds
FROM documents GROUP BY 1, 2, 3
""")
def inference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    responses = d.select(
        F.col("lang").alias("task"), F.lit(1).cast("bigint").alias("run_id"),
        (F.col("doc_id") % 3 + 1).cast("bigint").alias("gen"), (F.col("doc_id") % 5 != 0).alias("success"),
        F.col("n_chars").alias("prompt_tokens"), F.floor(F.length("text") / 7).cast("bigint").alias("completion_tokens"),
        (F.col("n_chars").cast("decimal(20,6)") / 1000).alias("elapsed_seconds"))
    return U.inference_summary(responses, ["task", "run_id", "gen"])


@register("batch_assignment", f"""
SELECT source, doc_id,
       CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {C.BATCH_SIZE} AS BIGINT) AS batch
FROM documents
""")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select("source", "doc_id")
    return R.assign_batches(d, ["source"], ["doc_id"])


@register("leaderboard", f"""
WITH {LABEL_CTES},
s AS (SELECT task, run_id, gen, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy,
             CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n_total
      FROM label_merged GROUP BY task, run_id, gen)
SELECT *, CAST(row_number() OVER (PARTITION BY task, run_id ORDER BY accuracy DESC NULLS LAST, gen) AS INTEGER)
  AS rank_in_run
FROM s
""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.summarize_label(G.grade_label(B.b_truth_label(spark, sf_dir), B.b_answers_label(spark, sf_dir)))
    return H.leaderboard(s, partition=["task", "run_id"]).withColumn("rank_in_run", F.col("rank_in_run").cast("int"))
