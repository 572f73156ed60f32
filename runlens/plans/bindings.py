"""Bindings: the driver's parquet tables viewed as runs, answers and truth.

The test tables have no runs tree, so each checked query reads them through a
deterministic view.  Every view here has a twin SQL fragment in
``plans/oracle.py`` that DuckDB runs on the same files; the two must stay in
step.  The views only relabel and derive columns -- they never subset rows to
make a check cheaper.

Task keys are real columns (a document's language or source), so the truth
grid is always an equi-join on data, never a join on a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.solution import extract_solution, solution_from_json
from ..operators.segments import PID, LOC, Segments

N_RUNS = 5        # runs answering every multiple-choice question
N_GENS = 4        # generations per run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- #
# Multiple choice
# --------------------------------------------------------------------------- #
def b_truth_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with truth: labelled documents.  task = language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = labels.join(docs, "doc_id")
    return j.select(
        F.col("lang").alias("task"),
        F.col("doc_id").alias("question_id"),
        F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), 1).alias("correct_answer"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("source")).alias("domain"),
        F.when(F.col("quality") == 1, F.lit("high")).otherwise(F.lit("low")).alias("subdomain"),
    )


def b_answers_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document answered by 5 runs x 4 generations; a raw answer is a
    6-character slice of the text.  Some answers are skipped, and some
    (run, question) pairs answer twice -- the later one (pos 1) wins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fan = docs.select(
        "doc_id", "text", "lang",
        F.explode(F.sequence(F.lit(0), F.lit(N_RUNS - 1))).alias("run_id"),
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(N_GENS))).alias("gen"))
    fan = fan.where((F.col("doc_id") + F.col("gen")) % 11 != 0)
    first = fan.select(
        F.col("lang").alias("task"), F.col("run_id").cast("bigint").alias("run_id"),
        F.col("gen").cast("bigint").alias("gen"), F.col("doc_id").alias("question_id"),
        F.substring("text", (F.col("run_id") * 7 + F.col("gen") * 13 + 1).cast("int"), 6).alias("answer"),
        F.lit(0).cast("bigint").alias("pos"),
    )
    again = fan.where((F.col("doc_id") + F.col("run_id")) % 17 == 0).select(
        F.col("lang").alias("task"), F.col("run_id").cast("bigint").alias("run_id"),
        F.col("gen").cast("bigint").alias("gen"), F.col("doc_id").alias("question_id"),
        F.substring("text", (F.col("run_id") * 5 + F.col("gen") * 11 + 3).cast("int"), 6).alias("answer"),
        F.lit(1).cast("bigint").alias("pos"),
    )
    return first.unionByName(again)


# --------------------------------------------------------------------------- #
# Labels
# --------------------------------------------------------------------------- #
LABEL_RUN = 7
LABEL_GENS = 2


def b_truth_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: every document's language; task = source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("task"), F.col("doc_id").alias("id"), F.col("lang").alias("label"))


def b_answers_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of run 7 over two generations: some wrong, some outside the
    class list ('xx'), some ids skipped, and ids divisible by 50 predicted twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    fan = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(LABEL_GENS))).alias("gen"))
    fan = fan.where((F.col("doc_id") + F.col("gen")) % 13 != 0)
    pred = (
        F.when((F.col("doc_id") + F.col("gen")) % 7 == 0, F.lit("xx"))
        .when((F.col("doc_id") * F.col("gen")) % 3 == 0, F.lit("en"))
        .otherwise(F.col("lang"))
    )
    base = fan.select(
        F.col("source").alias("task"), F.lit(LABEL_RUN).cast("bigint").alias("run_id"),
        F.col("gen").cast("bigint").alias("gen"), F.col("doc_id").alias("id"), pred.alias("pred_label"),
    )
    dup = base.where(F.col("id") % 50 == 0).withColumn("pred_label", F.lit("fr"))
    return base.unionByName(dup)


def b_label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class list of each task: the labels its truth uses."""
    return b_truth_label(spark, sf_dir).select("task", "label").distinct()


# --------------------------------------------------------------------------- #
# Open answers
# --------------------------------------------------------------------------- #
def _open_kind(doc_id):
    return doc_id % 5


def b_truth_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    k = _open_kind(F.col("doc_id"))
    expected_json = (
        F.when((k == 4) & (F.col("doc_id") % 10 == 9), F.lit('["a", "a", "b"]'))
        .when(k == 4, F.lit('["b", "a"]'))
        .otherwise(F.concat(F.lit('"'), F.col("n_chars").cast("string"), F.lit('"')))
    )
    return docs.select(
        F.col("lang").alias("task"),
        F.col("doc_id").cast("string").alias("question_id"),
        solution_from_json(F.parse_json(expected_json)).alias("expected"),
    )


def b_responses_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses: a whole document as the model's reasoning, then a solution line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    k = _open_kind(F.col("doc_id"))
    n = F.col("n_chars").cast("string")
    line = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.concat(F.lit("solution = "), n))
        .when(k == 2, F.concat(F.lit('solution = "'), n, F.lit('"')))
        .when(k == 3, F.concat(F.lit("Solution= "), (F.col("n_chars") + 1).cast("string")))
        .when(F.col("doc_id") % 10 == 9, F.lit("solution = ['a', 'b', 'b']"))
        .otherwise(F.lit("solution = ['a', 'b']"))
    )
    response = F.concat(F.col("text"), F.lit("\n"), line)
    base = docs.select(
        F.col("lang").alias("task"), F.lit(1).cast("bigint").alias("run_id"),
        (F.col("doc_id") % 3 + 1).cast("bigint").alias("gen"),
        F.col("doc_id").cast("string").alias("question_id"), response.alias("model_response"),
    )
    unknown = base.where(F.col("question_id").cast("bigint") % 50 == 0).withColumn(
        "question_id", F.concat(F.lit("x"), F.col("question_id"))
    )
    return base.unionByName(unknown)


def b_answers_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b_responses_open(spark, sf_dir)
    return r.select("task", "run_id", "gen", "question_id", extract_solution(F.col("model_response")).alias("solution"))


# --------------------------------------------------------------------------- #
# Containment classes, generations, metrics, logs, notes, usage, turns
# --------------------------------------------------------------------------- #
def b_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class list: benchmark passages (whole texts) in item_id order."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("pos"), F.col("text").alias("label"))


def b_history(spark: SparkSession, sf_dir: str) -> Segments:
    """Events as generations in segments of their run: run = user, gen = event order
    within the user (a distributed row number, so a user holding a large share of all
    events is spread over many tasks)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    runs = ev.withColumnRenamed("user_id", "run_id")
    return Segments.of(runs, ["run_id"], ["ts", "event_id"]).numbered("gen").derive(lambda e: e.select(
        "run_id", "gen", "event_id", "ts", "event_type",
        F.col("value").alias("accuracy"),
        (F.col("event_type") != "error").alias("success"), PID, LOC,
    ))


def b_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generations of ``b_history`` as a table."""
    return b_history(spark, sf_dir).df


def _metric_pairs():
    return F.inline(F.array(F.struct(F.lit("accuracy").alias("key"), F.col("accuracy").alias("num")),
                            F.struct(F.col("event_type").alias("key"), F.col("accuracy").alias("num"))))


def b_metrics(spark: SparkSession, sf_dir: str, gens: DataFrame | None = None) -> DataFrame:
    """Long metrics: ('accuracy', value) for every generation and (event_type, value)."""
    g = gens if gens is not None else b_generations(spark, sf_dir)
    return g.select("run_id", "gen", _metric_pairs())


def b_metric_history(spark: SparkSession, sf_dir: str) -> Segments:
    """The same in the segments of the generations."""
    return b_history(spark, sf_dir).derive(lambda g: g.select("run_id", "gen", _metric_pairs(), PID, LOC))


def b_log_lines(spark: SparkSession, sf_dir: str, gens: DataFrame | None = None) -> DataFrame:
    """One stdout log per generation, worded by event type."""
    g = gens if gens is not None else b_generations(spark, sf_dir)
    cents = F.round(F.col("accuracy") * 100).cast("bigint")
    v = F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                 F.lpad((cents % 100).cast("string"), 2, "0"))
    k = F.col("event_id") % 100
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Epoch done\nAccuracy: "), v, F.lit("%")))
        .when(F.col("event_type") == "click", F.concat(F.lit("val="), v, F.lit("\nsaved")))
        .when(F.col("event_type") == "purchase", F.concat(k.cast("string"), F.lit("/100 correct\n"), k.cast("string"), F.lit("/100 questions")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("validation: "), v, F.lit("\ntest accuracy = "), v))
        .otherwise(F.concat(F.lit("ERROR "), v))
    )
    return g.select("run_id", "gen", "event_type", "accuracy", text.alias("log"))


def b_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """improvement.md stand-ins: every line of a document turned into a bullet."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    note = F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n- "))
    return d.select("doc_id", note.alias("note"))


def b_code_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_agent.py versions: run = doc_id / 10, gen = doc_id % 10 + 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        (F.col("doc_id") / 10).cast("bigint").alias("run_id"),
        (F.col("doc_id") % 10 + 1).cast("bigint").alias("gen"),
        "text",
    )


def b_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-call token usage: run = supplier, model = return flag."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_orderkey").alias("question_id"),
        F.col("l_returnflag").alias("model"),
        F.col("l_quantity").alias("input_tokens"),
        F.col("l_extendedprice").alias("output_tokens"),
        F.col("l_linenumber").cast("double").alias("reasoning_tokens"),
        (F.col("l_linestatus") == "O").alias("success"),
    )


def b_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trajectories of four runs (run = conv_id % 4, gen 1)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") % 4).alias("run_id"), F.lit(1).cast("bigint").alias("gen"),
        F.col("conv_id").alias("question_id"), F.col("turn"), F.col("role"), F.col("text"),
    )


# Fixed parameters of the usage binding: USD per million tokens, by model.
PRICES = [("A", 0.15, 0.60), ("N", 3.00, 15.00), ("R", 0.00, 0.00)]


def b_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
