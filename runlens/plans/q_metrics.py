"""Registered queries of the metric evaluators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluators as X
from . import bindings as B
from .catalog import register
from .oracle import LABEL_CTES

RUNS = 3


def b_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document scored and measured by three runs; task = language."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("len"))
    truth = d.select(F.col("lang").alias("task"), F.col("doc_id").alias("question_id"), (F.col("doc_id") % 3 == 0).alias("positive"),
                     F.col("n_chars").alias("expected"))
    runs = d.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(RUNS).cast("bigint"))).alias("run_id"))
    answers = runs.select(
        F.col("lang").alias("task"), "run_id", F.lit(1).cast("bigint").alias("gen"), F.col("doc_id").alias("question_id"),
        (F.col("len") * F.col("run_id") % 97 + F.when(F.col("doc_id") % 3 == 0, F.col("run_id") * 9).otherwise(0)).cast("double").alias("score"),
        (F.col("len") + F.col("doc_id") % 7 * F.col("run_id") / 8).alias("value"))
    return answers, truth


SCORES = f"""
s AS (SELECT lang AS task, run_id, CAST(1 AS BIGINT) AS gen, doc_id AS question_id, doc_id % 3 = 0 AS positive, n_chars AS expected,
             CAST(length(text) * run_id % 97 + CASE WHEN doc_id % 3 = 0 THEN run_id * 9 ELSE 0 END AS DOUBLE) AS score,
             length(text) + (doc_id % 7) * run_id / 8 AS value
      FROM documents, (SELECT unnest(range(1, {RUNS + 1})) AS run_id))"""


@register("roc_auc", f"""
WITH {SCORES},
r AS (SELECT task, run_id, gen, positive,
             rank() OVER w + (count(*) OVER (PARTITION BY task, run_id, gen, score) - 1) / 2.0 AS mid
      FROM s WINDOW w AS (PARTITION BY task, run_id, gen ORDER BY score)),
a AS (SELECT task, run_id, gen, CAST(count(*) FILTER (WHERE positive) AS BIGINT) AS positives,
             CAST(count(*) FILTER (WHERE NOT positive) AS BIGINT) AS negatives, sum(mid) FILTER (WHERE positive) AS ranks
      FROM r GROUP BY task, run_id, gen)
SELECT task, run_id, gen, positives, negatives,
       round((ranks - CAST(positives AS DOUBLE) * (positives + 1) / 2) / (CAST(positives AS DOUBLE) * negatives), 9) AS auc
FROM a
""")
def roc_auc_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, truth = b_scores(spark, sf_dir)
    return X.evaluate("roc_auc", answers, truth)[1]


@register("rmse", f"""
WITH {SCORES}
SELECT task, run_id, gen, CAST(count(*) AS BIGINT) AS n,
       round(sqrt(avg(power(round(value, 3) - expected, 2))), 6) AS rmse
FROM s GROUP BY task, run_id, gen
""")
def rmse_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, truth = b_scores(spark, sf_dir)
    return X.evaluate("rmse", answers, truth)[1]


@register("label_dice", f"""
WITH {LABEL_CTES},
m AS (SELECT a.task, a.run_id, a.gen, t.label, a.pred_label FROM answers_label a LEFT JOIN truth_label t ON a.task = t.task AND a.id = t.id),
n AS (SELECT task, run_id, gen, c AS label, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (
        SELECT task, run_id, gen, label AS c, 1 AS t, 0 AS p, CASE WHEN label = pred_label THEN 1 ELSE 0 END AS h FROM m
        UNION ALL SELECT task, run_id, gen, pred_label, 0, 1, 0 FROM m) WHERE c IS NOT NULL GROUP BY task, run_id, gen, c)
SELECT task, run_id, gen, label, round(h * 2.0 / (t + p), 9) AS dice FROM n
""")
def label_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = B.b_answers_label(spark, sf_dir).withColumnRenamed("id", "question_id")
    return X.evaluate("dice", answers, B.b_truth_label(spark, sf_dir).withColumnRenamed("id", "question_id"))[0]


@register("rouge_l", """
WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.words AS a, b.words AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant'),
l AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb,
             list_last(list_reduce(a, lambda row, x: list_transform(range(1, len(b) + 2), lambda j: greatest(row[j],
               coalesce(list_max(list_transform(range(1, j), lambda k: CASE WHEN b[k] = x THEN row[k] + 1 ELSE 0 END)), 0))),
               list_transform(range(0, len(b) + 1), lambda z: 0))) AS lcs FROM p)
SELECT CAST('chat' AS VARCHAR) AS task, conv_id % 4 AS run_id, CAST(1 AS BIGINT) AS gen, conv_id * 1000 + turn AS question_id, CAST(lcs AS BIGINT) AS lcs,
       round(coalesce(lcs / nullif(na, 0), 0.0), 9) AS precision, round(coalesce(lcs / nullif(nb, 0), 0.0), 9) AS recall,
       round(coalesce(2 * lcs / nullif(na + nb, 0), 0.0), 9) AS f1
FROM l
""")
def rouge_l_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against the turn before it."""
    c = B.table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant' AND turn > 0").select(
        F.lit("chat").alias("task"), (F.col("conv_id") % 4).alias("run_id"), F.lit(1).cast("bigint").alias("gen"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    truth = c.select(F.lit("chat").alias("task"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("question_id"), F.col("text").alias("expected"))
    return X.evaluate("rouge_l", answers, truth)[0]


@register("silhouette", """
WITH p AS (SELECT vec_id, vec_id % 2 AS run_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT run_id, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p),
s AS (SELECT run_id, cluster, i, sum(x) AS s FROM e GROUP BY run_id, cluster, i),
z AS (SELECT run_id, cluster, count(*) AS n, sum(list_dot_product(v, v)) AS sq FROM p GROUP BY run_id, cluster),
c AS (SELECT s.run_id, s.cluster, list(s.s ORDER BY s.i) AS sum, any_value(z.n) AS n, any_value(z.sq) AS sq
      FROM s JOIN z ON s.cluster = z.cluster AND s.run_id = z.run_id GROUP BY s.run_id, s.cluster),
d AS (SELECT p.vec_id, p.run_id, p.cluster, c.cluster AS other, c.n, c.n * list_dot_product(p.v, p.v) + c.sq - 2 * list_dot_product(p.v, c.sum) AS total
      FROM p JOIN c ON p.run_id = c.run_id),
m AS (SELECT vec_id, run_id, cluster, max(CASE WHEN cluster = other AND n > 1 THEN greatest(total / (n - 1), 0) END) AS a,
             min(CASE WHEN cluster <> other THEN greatest(total / n, 0) END) AS b FROM d GROUP BY vec_id, run_id, cluster)
SELECT CAST('embeddings' AS VARCHAR) AS task, run_id, CAST(1 AS BIGINT) AS gen, vec_id AS question_id, cluster,
       CASE WHEN b IS NULL OR a IS NULL THEN 0.0 ELSE round((b - a) / greatest(a, b), 6) END AS silhouette
FROM m
""")
def silhouette_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as two runs' clusters, each of half the vectors."""
    v = B.table(spark, sf_dir, "embeddings")
    one = F.lit(1).cast("bigint")
    answers = v.select(F.lit("embeddings").alias("task"), (F.col("vec_id") % 2).alias("run_id"), one.alias("gen"), F.col("vec_id").alias("question_id"), F.col("label").alias("cluster"))
    truth = v.select(F.lit("embeddings").alias("task"), F.col("vec_id").alias("question_id"), F.col("embedding").cast("array<double>").alias("features"))
    return X.evaluate("silhouette", answers, truth)[0].drop("features")
