"""The custom-evaluator contract as a registry of DataFrame functions.

An evaluator maps (answers, truth) to graded rows; the engine supplies the
``(task, run_id, gen)`` keys and runs it over every generation at once, and
any top-level numeric column of the summary becomes a history metric.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grading as G
from . import metrics as M

Evaluator = Callable[[DataFrame, DataFrame], DataFrame]
_REGISTRY: dict[str, tuple[Evaluator, Callable[[DataFrame], DataFrame]]] = {}


def register_evaluator(name: str, summarize: Callable[[DataFrame], DataFrame]):
    def deco(fn: Evaluator) -> Evaluator:
        _REGISTRY[name] = (fn, summarize)
        return fn

    return deco


def evaluators() -> list[str]:
    return sorted(_REGISTRY)


def evaluate(name: str, answers: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graded rows and the per-generation summary of evaluator ``name``."""
    grade, summarize = _REGISTRY[name]
    graded = grade(answers, truth)
    return graded, summarize(graded)


def summary_metrics(summary: DataFrame) -> DataFrame:
    """Top-level numeric columns of a summary as long metric rows."""
    keys = set(G.GEN_KEYS)
    numeric = [f.name for f in summary.schema.fields
               if f.name not in keys and f.dataType.typeName() in ("long", "integer", "double", "decimal", "boolean")]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("num")) for c in numeric))
    return summary.select(*G.GEN_KEYS, F.inline(pairs))


def _mc_summary(graded: DataFrame) -> DataFrame:
    c = F.count_if
    agg = graded.groupBy(*G.GEN_KEYS).agg(
        F.count(F.lit(1)).alias("total_questions"), c(F.col("status") == "correct").alias("correct"),
        c(F.col("status") == "incorrect").alias("incorrect"), c(F.col("status") == "missing").alias("missing"),
        c(F.col("status") == "invalid").alias("invalid"))
    acc = F.coalesce(F.try_divide(F.col("correct").cast("double"), (F.col("correct") + F.col("incorrect")).cast("double")),
                     F.lit(0.0))
    return agg.withColumn("accuracy", F.round(acc, 6)).withColumn("accuracy_percent", F.round(acc * 100, 6))


register_evaluator("multiple_choice", _mc_summary)(lambda answers, truth: G.grade_mc(truth, answers))
register_evaluator("label", G.summarize_label)(lambda answers, truth: G.grade_label(truth, answers))
register_evaluator("open", G.summarize_open)(lambda answers, truth: G.grade_open(truth, answers))


def _matched(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers with their question's truth; an answer to an unknown question has none."""
    return answers.join(truth, ["task", "question_id"], "left")


def _mean(column: str):
    def summarize(graded: DataFrame) -> DataFrame:
        return graded.groupBy(*G.GEN_KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(column), 6).alias(column))

    return summarize


def _rouge(answers: DataFrame, truth: DataFrame) -> DataFrame:
    return M.rouge_l(_matched(answers, truth), [*G.GEN_KEYS, "question_id"])


def _silhouette(answers: DataFrame, truth: DataFrame) -> DataFrame:
    return M.silhouette(_matched(answers, truth), G.GEN_KEYS)


def _dice_summary(graded: DataFrame) -> DataFrame:
    return graded.groupBy(*G.GEN_KEYS).agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("dice"), 6).alias("macro_dice"))


# Answers and truth meet on (task, question_id).  roc_auc: score / positive; rmse: value / expected;
# dice: pred_label / label; rouge_l: text / expected; silhouette: cluster / features.
register_evaluator("roc_auc", lambda graded: M.roc_auc(graded, G.GEN_KEYS))(_matched)
register_evaluator("rmse", lambda graded: M.rmse(graded, G.GEN_KEYS))(_matched)
register_evaluator("dice", _dice_summary)(lambda answers, truth: M.dice(_matched(answers, truth), G.GEN_KEYS))
register_evaluator("rouge_l", _mean("f1"))(_rouge)
register_evaluator("silhouette", _mean("silhouette"))(_silhouette)
