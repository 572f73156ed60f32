"""Grading semantics on hand-written rows: duplicates, missing, invalid, shapes."""

import json

from pyspark.sql import functions as F

from runlens.operators import grading as G
from runlens.sources.artifacts import explode_submission, truth_mc_from_docs, truth_open_from_docs
from runlens.functions.json import strict_json
from runlens.functions.solution import extract_solution


def test_mc_last_duplicate_wins_and_missing(spark):
    truth = spark.createDataFrame(
        [("t", 1, "A", "Physics", "x"), ("t", 2, "B", "", "y"), ("t", 3, "C", "Bio", "z")],
        "task string, question_id bigint, correct_answer string, domain string, subdomain string")
    answers = spark.createDataFrame(
        [("t", 1, 1, 1, "b", 0), ("t", 1, 1, 1, "a", 1), ("t", 1, 1, 2, "AB", 0), ("t", 1, 1, 99, "C", 0)],
        "task string, run_id bigint, gen bigint, question_id bigint, answer string, pos bigint")
    s = G.summarize_mc(truth, answers).collect()[0]
    assert (s.total_questions, s.correct, s.incorrect, s.missing, s.invalid) == (3, 1, 1, 1, 0)
    assert s.duplicate_ids == 1            # question 1 answered twice; the later answer was graded
    assert s.accuracy == 0.5 and s.accuracy_percent == 50.0
    d = {r.question_id: r.status for r in G.grade_mc(truth, answers).collect()}
    assert d == {1: "correct", 2: "incorrect", 3: "missing"}
    dom = {r.domain: (r.total, r.correct) for r in G.domain_stats(truth, answers).collect()}
    assert dom == {"Physics": (1, 1), "Unknown": (1, 0), "Bio": (1, 0)}


def test_label_fanout_missing_invalid(spark):
    truth = spark.createDataFrame([("t", 1, "盗窃"), ("t", 2, "诈骗"), ("t", 3, "盗窃")],
                                  "task string, id bigint, label string")
    answers = spark.createDataFrame(
        [("t", 7, 1, 1, "盗窃"), ("t", 7, 1, 1, "诈骗"), ("t", 7, 1, 2, "抢劫")],
        "task string, run_id bigint, gen bigint, id bigint, pred_label string")
    merged = G.grade_label(truth, answers)
    s = G.summarize_label(merged).collect()[0]
    assert (s.n_total, s.n_correct) == (4, 1) and s.accuracy == 0.25
    assert sorted(r.pred_label for r in merged.collect()) == sorted(["盗窃", "诈骗", "抢劫", "__missing__"])
    assert [r.id for r in G.missing_ids(truth, answers).collect()] == [3]
    classes = truth.select("task", "label")
    assert [r.pred_label for r in G.invalid_labels(answers, classes).collect()] == ["抢劫"]


def test_open_submission_driven(spark):
    truth_doc = spark.createDataFrame([(json.dumps({"1": "218", "2": ["e4", "e4", "d5"], "3": "x"}),)], "t string")
    truth = truth_open_from_docs(truth_doc.select(strict_json(F.col("t")).alias("doc")), F.lit("open"))
    resp = spark.createDataFrame(
        [("open", 1, 1, "1", "solution = 0218"), ("open", 1, 1, "2", "solution = ['e4', 'd5', 'd5']"),
         ("open", 1, 1, "3", "no answer"), ("open", 1, 1, "9", "solution = 1"), ("open", 1, 1, "1", "solution = 5")],
        "task string, run_id bigint, gen bigint, question_id string, r string")
    answers = resp.select("task", "run_id", "gen", "question_id", extract_solution(F.col("r")).alias("solution"))
    graded = G.grade_open(truth, answers)
    st = sorted((r.question_id, r.status) for r in graded.collect())
    assert st == [("1", "CORRECT"), ("1", "WRONG"), ("2", "CORRECT"), ("3", "FAILED_INFERENCE"), ("9", "WRONG")]
    s = G.summarize_open(graded).collect()[0]
    assert (s.total_questions, s.correct, s.wrong_answer, s.failed_inference, s.accuracy_percent) == (5, 2, 2, 1, 40.0)


def test_submission_shapes_and_truth(spark):
    subs = [
        ("t", 1, 1, {"details": [{"question_id": 1, "model_answer": "b"}, {"question_id": "2", "model_answer": "C"},
                                 {"question_id": 1, "model_answer": "A"}, {"model_answer": "D"},
                                 {"question_id": 3}]}),
        ("t", 1, 2, {"answers": {"1": "A", " 2 ": "B", "x": "C"}, "details_count": 2}),
        ("t", 1, 3, {"1": "D", "model": "m", "accuracy": 0.5, "2": False, "3": None}),
    ]
    df = spark.createDataFrame([(a, b, c, json.dumps(d)) for a, b, c, d in subs],
                               "task string, run_id bigint, gen bigint, j string")
    rows = explode_submission(df.select("task", "run_id", "gen", strict_json(F.col("j")).alias("doc")))
    got = sorted((r.gen, r.question_id, r.answer, r.pos if r.gen == 1 else None) for r in rows.collect())
    # details keep list positions; object keys come back in key order (VARIANT).
    assert got == [(1, 1, "A", 2), (1, 1, "b", 0), (1, 3, "", 4), (2, 1, "A", None), (2, 2, "B", None),
                   (3, 1, "D", None), (3, 2, "False", None), (3, 3, "None", None)]
    truth_doc = [{"id": 1, "correct_answer_letter": "A", "domain": "Physics"},
                 {"id": None, "correct_answer_letter": "B"}, {"id": 2, "correct_answer_letter": ""},
                 {"id": 3, "correct_answer_letter": "C", "domain": None}, {"id": 1, "correct_answer_letter": "D"}]
    tdf = spark.createDataFrame([(json.dumps(truth_doc),)], "j string").select(strict_json(F.col("j")).alias("doc"))
    t = sorted((r.question_id, r.correct_answer, r.domain, r.subdomain) for r in
               truth_mc_from_docs(tdf, F.lit("t")).collect())
    assert t == [(1, "D", "N/A", "N/A"), (3, "C", None, "N/A")]
    answers = rows.where(F.col("gen") == 1)
    truth = truth_mc_from_docs(tdf, F.lit("t"))
    d = {r.question_id: (r.model_answer, r.status) for r in G.grade_mc(truth, answers).collect()}
    assert d == {1: ("A", "incorrect"), 3: ("", "missing")}


def test_grid_salted_path_equals_broadcast_path(spark):
    """Above the broadcast bound the truth grid is salted; the result is the same."""
    from runlens.operators.joins import expand_over, small_side

    gens = spark.createDataFrame([("t", r, g) for r in range(3) for g in range(1, 3)] + [("u", 9, 1)],
                                 "task string, run_id int, gen int")
    truth = spark.createDataFrame([("t", q) for q in range(50)] + [("u", 7)], "task string, question_id int")
    fast = sorted(tuple(r) for r in expand_over(gens, truth, "task", salt_col="question_id").collect())
    salted = sorted(tuple(r) for r in expand_over(gens, truth, "task", max_rows=0, salt=8,
                                                  salt_col="question_id").collect())
    assert fast == salted and len(fast) == 6 * 50 + 1
    assert small_side(truth, max_rows=0) is truth


def test_grid_with_tasks_missing_from_truth(spark):
    from runlens.operators.joins import expand_over

    gens = spark.createDataFrame([("t", 1), ("nope", 2)], "task string, run_id int")
    truth = spark.createDataFrame([("t", 1), ("t", 2)], "task string, question_id int")
    got = sorted(tuple(r) for r in expand_over(gens, truth, "task").collect())
    assert got == [("t", 1, 1), ("t", 1, 2)]
