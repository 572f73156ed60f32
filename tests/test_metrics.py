"""Metric evaluators against direct definitions."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators import evaluators as X
from runlens.operators import metrics as M
from runlens.operators.segments import Segments

KEYS = ["task", "run_id", "gen"]


def test_auc_counts_pairs(spark):
    rng = random.Random(3)
    rows = [("t", r, 1, rng.choice([None, *map(float, range(12))]), rng.choice([True, False, None])) for r in range(3) for _ in range(90 * (r + 1))]
    rows += [("t", 9, 1, 1.0, True)]                       # no pair
    df = spark.createDataFrame(rows, "task string, run_id long, gen long, score double, positive boolean")
    got = {r.run_id: (r.positives, r.negatives, r.auc) for r in M.roc_auc(df, KEYS).collect()}
    for run in (0, 1, 2):
        pos = [s for _, r, _, s, p in rows if r == run and s is not None and p is True]
        neg = [s for _, r, _, s, p in rows if r == run and s is not None and p is False]
        won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert got[run] == (len(pos), len(neg), pytest.approx(won / len(pos) / len(neg), abs=1e-9))
    assert got[9] == (1, 0, None)


def test_running_sums_span_segments(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 5 != 0, 1).alias("v"))
    for n in (1, 9):
        got = {(r.g, r.o): r.s for r in Segments.of(df, ["g"], ["o"], n).scan(before={"s": "v"}).collect()}
        assert got == {(o % 2, o): sum(x % 5 != 0 for x in range(o % 2, o, 2)) for o in range(500)}


@given(st.lists(st.sampled_from("abc"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_common_subsequence_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert M.common_subsequence(a, b) == row[-1]


def test_rouge_of_edges(spark):
    rows = [(1, "the cat sat", "the cat on the mat sat"), (2, None, "x"), (3, "", None), (4, "a\tb\n", "b a b")]
    df = spark.createDataFrame(rows, "id long, text string, expected string")
    got = {r.id: (r.lcs, r.precision, r.recall, r.f1) for r in M.rouge_l(df, ["id"]).collect()}
    assert got == {1: (3, 1.0, 0.5, round(6 / 9, 9)), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0), 4: (2, 1.0, round(2 / 3, 9), 0.8)}


def test_silhouette_by_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    pts = [("t", g, 1, i, c, [rng.gauss(3 * c, 1), rng.gauss(0, 1)]) for g in (1, 2) for i, c in enumerate([0] * 9 + [1] * 12 + [2])]
    pts += [("t", 3, 1, 0, 5, [1.0, 1.0]), ("t", 3, 1, 1, 5, [2.0, 1.0]), ("t", 1, 1, 90, None, [1.0, 1.0]), ("t", 1, 1, 91, 1, None)]
    df = spark.createDataFrame(pts, "task string, run_id long, gen long, id long, cluster int, features array<double>")

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    want = {}
    for _, g, _, i, c, v in pts:
        if c is None or v is None:
            continue
        others = {}
        for _, h, _, j, d, w in pts:
            if h == g and d is not None and w is not None and (j != i):
                others.setdefault(d, []).append(dist(v, w))
        means = {d: sum(x) / len(x) for d, x in others.items()}
        a, b = means.get(c), min((m for d, m in means.items() if d != c), default=None)
        want[g, i] = 0.0 if a is None or b is None else (b - a) / max(a, b)
    for bound in (100_000, 1):
        monkeypatch.setattr(M, "MAX_CLUSTERS", bound)
        got = {(r.run_id, r.id): r.silhouette for r in M.silhouette(df, KEYS).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_evaluators_meet_truth_by_question(spark):
    truth = spark.createDataFrame([("t", 1, "a", 2.0), ("t", 2, "b", 4.0), ("t", 3, "a", 1.0)], "task string, question_id long, label string, expected double")
    answers = spark.createDataFrame([("t", 1, 1, 1, "a", 2.5), ("t", 1, 1, 2, "a", 4.0), ("t", 1, 1, 3, None, None), ("t", 1, 1, 7, "c", 9.0)],
                                    "task string, run_id long, gen long, question_id long, pred_label string, value double")
    per_class, summary = X.evaluate("dice", answers, truth)
    assert {r.label: r.dice for r in per_class.collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}
    assert summary.first().macro_dice == round(0.5 / 3, 6)
    r = X.evaluate("rmse", answers, truth)[1].first()
    assert (r.n, r.rmse) == (2, round((0.25 / 2) ** 0.5, 6))
    assert {m.key for m in X.summary_metrics(summary).collect()} == {"classes", "macro_dice"}
