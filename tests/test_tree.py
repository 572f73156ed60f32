"""Runs-tree sources on small trees written here."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from runlens.plans.tree_plans import run_history, run_overview
from runlens.sources import sinks
from runlens.sources import tree as S
from runlens.sources.artifacts import trajectory_turns


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def runs_root(tmp_root):
    root = os.path.join(tmp_root, "runs")
    r = os.path.join(root, "run_12")
    write(os.path.join(r, "context.md"),
          "Notes on this run\n**Task**: /data/quiz\n  **Meta Model**:   planner-1\n**Task Model**: old\n**Task Model**: solver-2\n"
          "**Agent impl**: toolbox\n**Max Generations**: 5\n## First generation\n**Task**: not-a-header\n")
    g1 = os.path.join(r, "gen_1")
    write(os.path.join(g1, "target_agent.py"), "answers = {}\n")
    write(os.path.join(g1, "meta_agent_prompt.txt"), "write an agent")
    marks = [("Optics", True), ("Optics", True), ("Botany", True), ("Botany", False), ("Botany", False)]
    details = [{"question_id": i, "domain": d, "is_correct": ok} for i, (d, ok) in enumerate(marks, start=10)]
    write(os.path.join(g1, "evaluation_results.json"), json.dumps(
        {"total_questions": 5, "correct": 3, "incorrect": 2, "accuracy_percent": 60.0, "details": details}))
    write(os.path.join(g1, "agent_execution", "execution_q4.json"), json.dumps([
        {"role": "system", "content": [{"type": "text", "text": "Name the plant."}]},
        {"content": "Which one bends light?"},
        {"role": "assistant", "content": ["A prism", {"type": "text", "text": "is no plant."}]}]))
    write(os.path.join(r, "gen_2", "improvement.md"), "* nothing yet\n")
    write(os.path.join(root, "run_x", "notes.txt"), "ignored")
    write(os.path.join(root, "other", "gen_1", "x.json"), "{}")
    return root


def test_run_overview(spark, runs_root):
    rows = run_overview(spark, runs_root).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.run_id == 12 and r.agent_impl == "toolbox" and r.task_model == "solver-2" and r.meta_model == "planner-1"
    assert r.max_generations == 5 and r.num_generations == 2
    assert r.best_accuracy_percent == 60.0
    g1 = [g for g in r.generations if g.gen == 1][0]
    assert g1.accuracy_percent == 60.0 and g1.has_target_agent and g1.has_meta_prompt
    assert list(g1.trajectories) == [4]


def test_domain_stats_and_details(spark, runs_root):
    files = S.scan_runs(spark, runs_root)
    ev = S.eval_summaries(spark, files, runs_root)
    det = S.eval_details(ev)
    assert det.count() == 5
    dom = {r.domain: r for r in S.domain_stats_from_details(det).collect()}
    assert dom["Optics"].correct == 2 and dom["Optics"].total == 2
    assert dom["Botany"].accuracy_percent == 33.333333


def test_trajectory_normalization(spark, runs_root):
    files = S.scan_runs(spark, runs_root)
    ex = S.load_executions(spark, files, runs_root)
    turns = trajectory_turns(ex).orderBy("turn").collect()
    assert [t.role for t in turns] == ["system", "unknown", "assistant"]
    assert [t.text for t in turns] == ["Name the plant.", "Which one bends light?", "A prism\n\nis no plant."]
    outcome = {(r.gen, r.status) for r in ex.collect()}
    assert outcome == {(1, "ok"), (2, "not_found")}


def test_missing_root_is_empty(spark, tmp_root):
    assert S.scan_runs(spark, os.path.join(tmp_root, "nope")).count() == 0


@pytest.mark.parametrize("size,cap,kept", [(11, 1024, True), (2000, 1000, False), (1000, 1000, True)])
def test_size_cap_boundary(spark, tmp_root, size, cap, kept):
    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_1", "gen_1", "a.txt"), "a" * size)
    files = S.scan_runs(spark, root)
    r = S.read_text_capped(spark, files, root, cap).collect()[0]
    assert (r.text == "a" * size) if kept else (r.text is None and r.bad_reason == "TOO_LARGE")


def test_json_cap_and_invalid(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    g = os.path.join(root, "run_1", "gen_1")
    write(os.path.join(g, "ok.json"), json.dumps({"accuracy": 0.95}))
    write(os.path.join(g, "big.json"), json.dumps({"key": "x" * 5000}))
    write(os.path.join(g, "bad.json"), "{not valid json")
    write(os.path.join(g, "trail.json"), "[1] x")
    write(os.path.join(g, "empty.json"), "")
    files = S.scan_runs(spark, root)
    got = {r.name: r for r in S.read_json_capped(spark, files, root, 1000).collect()}
    assert got["ok.json"].doc is not None and got["ok.json"].bad_reason is None
    assert got["big.json"].doc is None and got["big.json"].bad_reason == "TOO_LARGE"
    assert got["bad.json"].doc is None and got["bad.json"].bad_reason == "INVALID_JSON"
    assert got["trail.json"].doc is None and got["trail.json"].bad_reason == "TRAILING_DATA"
    # Zero-byte files never reach a binaryFile scan: an empty artefact reads as absent.
    assert "empty.json" not in got


def test_execution_formats(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    r = os.path.join(root, "run_1")
    write(os.path.join(r, "gen_1", "agent_execution.json"), "{not valid json")
    for i in (0, 1, 2, 10):
        write(os.path.join(r, "gen_2", "agent_execution", f"execution_q{i}.json"),
              json.dumps([{"role": "user", "content": f"q{i}"}]))
    write(os.path.join(r, "gen_2", "agent_execution.json"), "[]")   # folder wins
    write(os.path.join(r, "gen_3", "agent_execution", "notes.txt"), "x")  # folder without trajectories
    write(os.path.join(r, "gen_4", "x.txt"), "x")
    files = S.scan_runs(spark, root)
    ex = S.load_executions(spark, files, root).collect()
    by_gen = {}
    for row in ex:
        by_gen.setdefault(row.gen, []).append(row)
    g1 = by_gen[1][0]
    assert (g1.is_multi, g1.status, g1.raw_preview, g1.file_chars) == (False, "bad_json", "{not valid json", 15)
    g2 = sorted(by_gen[2], key=lambda x: x.ord)
    assert [x.file for x in g2] == ["execution_q0.json", "execution_q1.json", "execution_q10.json",
                                    "execution_q2.json"]
    assert all(x.is_multi and x.status == "ok" for x in g2)
    assert [(x.is_multi, x.status) for x in by_gen[3]] == [(True, "empty_folder")]
    assert [(x.is_multi, x.status) for x in by_gen[4]] == [(False, "not_found")]
    ids = {r.gen: list(r.trajectories) for r in S.trajectory_ids(files).collect()}
    assert ids[2] == [0, 1, 2, 10]


def test_submission_discovery(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    g = os.path.join(root, "run_1", "gen_1")
    write(os.path.join(g, "output_a.json"), "{}")
    write(os.path.join(g, "submission_b.json"), "{}")
    write(os.path.join(g, "zzz.json"), "{}")
    g2 = os.path.join(root, "run_1", "gen_2")
    write(os.path.join(g2, "results", "r1.json"), "{}")
    write(os.path.join(g2, "results_top.json"), "{}")
    g3 = os.path.join(root, "run_1", "gen_3")
    write(os.path.join(g3, "responses.json"), "[]")
    write(os.path.join(g3, "anything.json"), "{}")
    files = S.scan_runs(spark, root)
    mc = {r.gen: r.rel_path for r in S.discover_submission(files).collect()}
    assert mc[1] == "submission_b.json" and mc[2] == "results/r1.json"
    assert mc[3] in ("anything.json", "responses.json")  # both "any json": newest, then path
    op = {r.gen: r.rel_path for r in S.discover_submission(files, open_task=True).collect()}
    assert op[3] == "responses.json"
    pick = {r.gen: r.rel_path for r in S.pick_by_priority(files, ("results/r1.json", "results_top.json")).collect()}
    assert pick == {2: "results/r1.json"}


def test_golden_history(spark, tmp_root):
    """Two generations: sizes, deltas and finals."""
    root = os.path.join(tmp_root, "runs")
    r = os.path.join(root, "run_1")
    write(os.path.join(r, "gen_1", "target_agent.py"), "x = solve(questions)\n")
    write(os.path.join(r, "gen_2", "target_agent.py"),
          "import json\n\n\ndef answer(q):\n    return json.dumps(q)\n\n\n# the end it\n")
    write(os.path.join(r, "gen_2", "improvement.md"),
          "- the parser now skips a broken row and goes on with the next one\n"
          "2. wrong units were the cause of every second miss, so they are converted\n"
          "* a cache of earlier answers halves the time that one run takes\n")
    write(os.path.join(r, "gen_1", "results.json"), json.dumps({"accuracy": 50.0, "correct": 99, "total": 198}))
    write(os.path.join(r, "gen_2", "results.json"), json.dumps({"accuracy": 75.0, "correct": 148, "total": 198}))
    h = run_history(spark, root)
    gens = {g.gen: g for g in h["generations"].collect()}
    assert (gens[1].size, gens[1].lines, gens[2].size, gens[2].lines) == (21, 1, 69, 8)
    assert round(gens[2].size_pct, 1) == 228.6 and gens[2].lines_delta == 7
    deltas = {d.key: d.delta for d in h["deltas"].collect()}
    assert deltas == {"accuracy": 25.0, "correct": 49.0, "total": 0.0}
    fin = h["finals"].collect()[0]
    assert fin.best_gen == 2 and fin.size_growth == 48 and fin.lines_growth == 7
    assert fin.accuracy_gain == 25.0 and fin.total_generations == 2
    assert h["insights"].count() == 3


def test_best_generation_rules(spark):
    """Ties keep the earliest; a run with no metric has no best generation."""
    from runlens.operators.history import run_finals

    df = spark.createDataFrame([(1, 1, 70.0), (1, 2, 80.0), (1, 3, 80.0), (2, 1, None), (2, 2, None)],
                               "run_id int, gen int, accuracy double")
    got = {r.run_id: r.best_gen for r in run_finals(df).collect()}
    assert got == {1: 2, 2: None}


def test_bad_json_reasons(spark):
    from runlens.functions.json import json_bad_reason

    rows = [('{"a":1,"a":2}', "DUP_KEY"), ('{"a": NaN}', "NAN_LITERAL"), ("[1] x", "TRAILING_DATA"),
            ("{bad", "INVALID_JSON"), ("  ", "EMPTY"), ('{"ok": [1, 2]}', None)]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("t", "want", json_bad_reason(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r


def test_run_names_sharing_an_index(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_7", "gen_1", "a.txt"), "x")
    write(os.path.join(root, "run_07", "gen_2", "b.txt"), "y")
    write(os.path.join(root, "run_7x", "gen_1", "c.txt"), "z")
    rows = sorted((r.run_name, r.run_id, r.gen) for r in S.scan_runs(spark, root).collect())
    assert rows == [("run_07", 7, 2), ("run_7", 7, 1)]


def test_history_edges(spark):
    """Gaps in generation numbers, percent strings, zero previous size."""
    from runlens.operators.history import code_growth, metric_deltas

    m = spark.createDataFrame(
        [(1, 1, "accuracy", "string", None, "48.5%"), (1, 3, "accuracy", "float", 50.0, None),
         (1, 3, "note", "string", None, "n/a"), (1, 4, "note", "string", None, "x")],
        "run_id int, gen int, key string, kind string, num double, str string")
    got = [(r.gen, r.prev_gen, r.key, r.delta) for r in metric_deltas(m).collect()]
    assert got == [(3, 1, "accuracy", 1.5)]          # gen 3 follows gen 1; "n/a" never parses
    v = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 10, 2)], "run_id int, gen int, size int, lines int")
    g = {r.gen: (r.size_pct, r.lines_delta) for r in code_growth(v).collect()}
    assert g == {1: (None, None), 2: (None, 2)}


def test_label_leaderboard_over_a_tree(spark, tmp_root):
    from runlens.plans.tree_plans import label_leaderboard

    root = os.path.join(tmp_root, "runs")
    r = os.path.join(root, "run_1")
    write(os.path.join(r, "gen_1", "submission.csv"), "id,label\n1,盗窃\n2,诈骗\n3,盗窃\n")
    write(os.path.join(r, "gen_1", "predictions.csv"), "id,label\n1,x\n")          # submission.csv wins
    write(os.path.join(r, "gen_2", "predictions.csv"), "id,text,charge\n1,a,盗窃\n2,b,盗窃\n")
    write(os.path.join(r, "gen_3", "submission.csv"), "row,label\n1,盗窃\n")       # no id column
    write(os.path.join(r, "gen_4", "notes.txt"), "no submission")
    truth = spark.createDataFrame([(1, "盗窃"), (2, "诈骗"), (3, "盗窃")], "id bigint, label string")
    rows = {r.gen: r for r in label_leaderboard(spark, root, truth, "law").collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1].accuracy, rows[1].n_correct, rows[1].n_total, rows[1].rank_in_run) == (1.0, 3, 3, 1)
    assert (round(rows[2].accuracy, 6), rows[2].n_correct, rows[2].n_total) == (round(1 / 3, 6), 1, 3)
    assert rows[3].accuracy is None and rows[3].bad_reason == "NO_ID_COLUMN"


def test_trajectory_outcomes_on_executions(spark, tmp_root):
    from runlens.operators.trajectories import trajectory_outcomes

    root = os.path.join(tmp_root, "runs")
    d = os.path.join(root, "run_1", "gen_1", "agent_execution")
    write(os.path.join(d, "execution_q0.json"), json.dumps([{"role": "user", "content": "q"}]))
    write(os.path.join(d, "execution_q1.json"), "{broken")
    write(os.path.join(d, "execution_q2.json"), json.dumps({"error": "agent crashed"}))
    write(os.path.join(d, "execution_q3.json"), json.dumps({"note": "no error key"}))
    files = S.scan_runs(spark, root)
    o = trajectory_outcomes(S.load_executions(spark, files, root), ["run_id", "gen"]).collect()[0]
    assert (o["count"], o.successful, o.failed) == (4, 1, 2)


def test_plans_read_the_ingested_table(spark, runs_root, tmp_root):
    """Analytics off the ingested parquet equal analytics off the tree."""
    from runlens.sources import sinks as K

    ing = K.ingest(spark, runs_root, os.path.join(tmp_root, "ingested"))
    a = run_overview(spark, runs_root).collect()[0]
    b = run_overview(spark, runs_root, files=ing).collect()[0]
    assert a.asDict(recursive=True) == b.asDict(recursive=True)
    files = S.scan_runs(spark, runs_root)
    t1 = sorted(tuple(r) for r in trajectory_turns(S.load_executions(spark, files, runs_root))
                .drop("content").collect())
    t2 = sorted(tuple(r) for r in trajectory_turns(S.load_executions(spark, ing, runs_root))
                .drop("content").collect())
    assert t1 == t2 and len(t1) == 3


def test_context_header_matches_reference_rules(spark, tmp_root):
    import random

    import pyref

    rnd = random.Random(5)
    keys = ["Task", "Meta Model", "task", "Agent impl", "Started", "Max Generations", "max generations"]
    pieces = ["# Run Context", "## Generation 1", "#not a heading", "  **Task**:  spaced  ", "**Bad*Key**: x",
              "**Max Generations**: 1_0", "**Max Generations**: +3", "", "text", "##nospace", "\x0c"]
    root = os.path.join(tmp_root, "runs")
    texts = {}
    for run in range(1, 25):
        lines = [rnd.choice(pieces) if rnd.random() < 0.4 else f"**{rnd.choice(keys)}**: v{rnd.randint(0, 9)}"
                 for _ in range(rnd.randint(0, 12))]
        sep = rnd.choice(["\n", "\r\n", "\r"])
        texts[run] = sep.join(lines)
        write(os.path.join(root, f"run_{run}", "context.md"), texts[run] or "x")
        texts[run] = texts[run] or "x"
    files = S.scan_runs(spark, root)
    got = {r.run_id: r for r in S.parse_context(spark, files, root).collect()}
    for run, text in texts.items():
        want = pyref.parse_context(text)
        r = got[run]
        assert r.task == want.get("task") and r.meta_model == want.get("meta model"), (text, want)
        assert r.agent_impl == want.get("agent impl") and r.started == want.get("started"), (text, want)
        mg = want.get("max generations")
        try:
            mg = int(mg) if mg is not None else None
        except ValueError:
            mg = None
        assert r.max_generations == mg, (text, want)


def test_label_submissions_with_ragged_rows(spark, tmp_root):
    from runlens.sources.artifacts import label_submissions

    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_1", "gen_1", "submission.csv"), "id,label\n1,a\n2\n3,c,extra\n")
    write(os.path.join(root, "run_1", "gen_2", "submission.csv"), "\n\n")
    files = S.scan_runs(spark, root)
    rows = sorted((r.gen, r.id, r.pred_label, r.bad_reason) for r in label_submissions(spark, files, root).collect())
    assert rows == [(1, 1, "a", None), (1, 2, None, None), (1, 3, "c", None), (2, None, None, "EMPTY")]


def test_oversized_numbers_do_not_raise(spark, tmp_root):
    """ANSI casts raise on overflow; names and headers with huge numbers give NULL instead."""
    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_99999999999", "gen_1", "a.txt"), "x")
    write(os.path.join(root, "run_2", "context.md"), "**Max Generations**: 99999999999\n")
    write(os.path.join(root, "run_2", "gen_1", "agent_execution", "execution_q99999999999.json"), "[]")
    files = S.scan_runs(spark, root)
    assert sorted((r.run_name, r.run_id) for r in files.select("run_name", "run_id").distinct().collect()) == [
        ("run_2", 2), ("run_99999999999", None)]
    assert S.parse_context(spark, files, root).collect()[0].max_generations is None
    assert trajectory_turns(S.load_executions(spark, files, root)).count() == 0


def test_three_result_layouts_read_canonically(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    r = os.path.join(root, "run_1")
    write(os.path.join(r, "gen_1", "evaluation_results.json"), json.dumps(
        {"total_questions": 4, "correct": 3, "incorrect": 1, "missing": 0, "accuracy": 0.75, "details": [{}]}))
    write(os.path.join(r, "gen_2", "results.json"), json.dumps(
        {"accuracy": 0.5, "n_correct": 2, "n_total": 4, "per_class": {"a": 0.5}}))
    write(os.path.join(r, "gen_3", "evaluation_results.json"), json.dumps(
        {"summary": {"total_questions": 5, "correct": 2, "wrong_answer": 2, "failed_inference": 1, "accuracy": 40.0},
         "results": [{"question_id": "1"}, {"question_id": "2"}]}))
    write(os.path.join(r, "gen_4", "results.json"), json.dumps({"total_questions": 0, "total": 9, "accuracy": True}))
    files = S.scan_runs(spark, root)
    canon = {x.gen: (x.total, x.correct, x.incorrect, x.missing, x.accuracy_percent)
             for x in S.eval_summaries(spark, files, root).collect()}
    assert canon == {1: (4, 3, 1, 0, 75.0), 2: (4, 2, None, None, 50.0), 3: (5, 2, 2, 1, 40.0),
                     4: (9, None, None, None, 100.0)}
    ref = {x.gen: (x.total, x.correct, x.accuracy_percent) for x in
           S.eval_summaries(spark, files, root, as_reference=True).collect()}
    assert ref[2] == (None, None, 50.0) and ref[3] == (None, None, None)
    n = {x.gen: x.c for x in S.eval_details(S.eval_summaries(spark, files, root)).groupBy("gen")
         .agg(F.count("*").alias("c")).collect()}
    assert n == {1: 1, 3: 2}


def test_same_index_different_names_stay_apart(spark, tmp_root):
    """run_7 / run_07 and gen_1 / gen_01 are different directories sharing an index."""
    root = os.path.join(tmp_root, "runs")
    _ = [write(os.path.join(root, run, gen, "evaluation_results.json"), json.dumps({"accuracy_percent": acc}))
         for run, gen, acc in (("run_7", "gen_1", 10.0), ("run_7", "gen_01", 20.0), ("run_07", "gen_1", 30.0))]
    rows = {r.run_name: r for r in run_overview(spark, root).collect()}
    assert set(rows) == {"run_7", "run_07"} and rows["run_7"].run_id == rows["run_07"].run_id == 7
    assert rows["run_7"].num_generations == 2 and rows["run_07"].num_generations == 1
    assert rows["run_7"].best_accuracy_percent == 20.0 and rows["run_07"].best_accuracy_percent == 30.0
    assert sorted(g.gen_name for g in rows["run_7"].generations) == ["gen_01", "gen_1"]


def test_label_leaderboard_keeps_run_names_apart(spark, tmp_root):
    from runlens.plans.tree_plans import label_leaderboard

    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_7", "gen_1", "submission.csv"), "id,label\n1,a\n2,b\n")
    write(os.path.join(root, "run_07", "gen_1", "submission.csv"), "id,label\n1,a\n2,x\n")
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, label string")
    got = {r.run_name: (r.run_id, r.gen, r.accuracy, r.rank_in_run) for r in
           label_leaderboard(spark, root, truth, "law").collect()}
    assert got == {"run_7": (7, 1, 1.0, 1), "run_07": (7, 1, 0.5, 1)}


def test_chosen_files_are_one_scan(spark, tmp_root, monkeypatch):
    """Only chosen files are listed and opened, and no exchange carries their bytes."""
    import contextlib
    import io

    root = os.path.join(tmp_root, "runs")
    for i in range(6):
        write(os.path.join(root, "run_1", f"gen_{i}", "a.json"), json.dumps({"i": i}))
        write(os.path.join(root, "run_1", f"gen_{i}", "other.json"), "{broken")
    write(os.path.join(root, "run_1", "gen_9", "a[1]{x}*.json"), '{"i": 9}')
    files = S.scan_runs(spark, root).where(~F.col("name").startswith("other"))
    for most in (50_000, 2):
        monkeypatch.setattr(S, "MAX_PATHS", most)
        got = S.read_json_capped(spark, files, root)
        rows = {r.gen: r.i for r in got.select("gen", F.try_variant_get("doc", "$.i", "int").alias("i"), "bad_reason").collect()}
        assert rows == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 9: 9}
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            got.explain()
        lines = buf.getvalue().splitlines()
        assert not [line for line in lines if " Exchange " in line]
        assert not [line for line in lines if "BroadcastExchange" in line and "content" in lines[lines.index(line) + 1]]
    monkeypatch.setattr(S, "MAX_PATHS", 50_000)
    capped = {r.gen: r.bad_reason for r in S.read_text_capped(spark, files, root, 7).collect()}
    assert set(capped.values()) == {"TOO_LARGE"}


def test_numbering_trajectories_moves_no_document(spark, runs_root):
    files = sinks.ingest(spark, runs_root, os.path.join(os.path.dirname(runs_root), "numbered"))
    ex = S.load_executions(spark, files, runs_root).where("is_multi AND status = 'ok'")
    plan = spark._jvm.PythonSQLUtils.explainString(ex._jdf.queryExecution(), "formatted")
    moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) (Window|Sort|Exchange)", part.strip())]
    assert any("Window" in part for part in moved) and not any("text#" in part or "doc#" in part for part in moved)
    got = {}
    for r in ex.select("run_name", "gen_name", "file", "ord").collect():
        got.setdefault((r.run_name, r.gen_name), []).append((r.ord, r.file))
    assert got and all([o for o, _ in sorted(v)] == list(range(1, len(v) + 1)) and [f for _, f in sorted(v)] == sorted(f for _, f in v) for v in got.values())
