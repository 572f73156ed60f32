"""Smaller operators: flatten, evaluators, outcomes, tool pairing, events, sinks, loaders."""

import csv
import io
import json
import os
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens import config as C
from runlens.functions.csv import csv_fields, csv_records
from runlens.functions.flatten import flatten_rows, js_number
from runlens.functions.json import strict_json
from runlens.functions.text import parse_percent, tail_lines
from runlens.operators import evaluators as X
from runlens.operators.trajectories import tool_calls, trajectory_outcomes
from runlens.sources import sinks as K
from runlens.sources import tree as S
from runlens.sources.artifacts import block_text, label_submissions, load_label_submission, load_truth_label, resolve_label_column


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _recursed(value, prefix=""):
    """Rows by plain recursion (small depths), numbers as they are in the tests' own table."""
    out = []
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else k
        if v is None or v == "":
            continue
        if isinstance(v, dict):
            out += _recursed(v, key)
        else:
            out.append((key, _printed(v, ", ")))
    return out


def _printed(v, by=","):
    if isinstance(v, list):
        return by.join("" if x is None else _printed(x) for x in v)
    if isinstance(v, dict):
        return "[object Object]"
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)


def test_flatten_equals_recursion_at_any_depth(spark):
    rng = random.Random(12)

    def value(depth):
        kind = rng.randrange(9)
        if kind < 3 and depth:
            return {rng.choice("abckv") + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        if kind == 3 and depth:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([None, "", "x y", 7, -3, True, False, "é\"q\n"])

    docs = [{f"r{i}": value(7) for i in range(4)} for _ in range(60)]
    deep = "leaf"
    for i in range(600):
        deep = {f"k{i}": deep}
    docs.append(deep)
    df = spark.createDataFrame([(i, f"c{i}", json.dumps(d)) for i, d in enumerate(docs)], "k int, v string, j string")
    got = {}
    for r in flatten_rows(df.select("k", "v", strict_json(F.col("j")).alias("_doc")), "_doc", ["k", "v"]).collect():
        assert r.v == f"c{r.k}"
        got.setdefault(r.k, []).append((r.key, r.value))
    for i, d in enumerate(docs[:-1]):
        assert sorted(got.get(i, [])) == sorted(_recursed(d)), d
    assert got[60] == [(".".join(f"k{i}" for i in reversed(range(600))), "leaf")]
    others = spark.createDataFrame([("[1]",), ("null",), ("3",), (None,)], "j string").select(strict_json(F.col("j")).alias("d"))
    assert flatten_rows(others, "d", []).collect() == []


def test_numbers_as_a_browser_prints_them():
    """Literal values from the language's number-to-string rules."""
    table = {"50.0": "50", "-0.0": "0", "0.1": "0.1", "1e21": "1e+21", "123456789012345680000": "123456789012345680000", "1e-7": "1e-7",
             "0.000001": "0.000001", "1.5e300": "1.5e+300", "-2.50": "-2.5", "12345678901234567890": "12345678901234567000", "1e5": "100000"}
    assert {k: js_number(k) for k in table} == table


def test_default_caps_and_timeout():
    assert (C.MAX_CONTEXT_FILE_SIZE, C.MAX_EXECUTION_LOG_SIZE, C.EVALUATOR_TIMEOUT) == (10_000_000, 50_000_000, 600)


def test_truth_of_error_values(spark):
    """An error is one that Python counts as true."""
    values = {"{}": 0, "[]": 0, '""': 0, "0": 0, "0.0": 0, "false": 0, "null": 0, '"0"': 1, '"false"': 1, '"x"': 1, "1": 1,
              "-0.5": 1, "true": 1, '{"a": null}': 1, "[0]": 1}
    rows = [(i, '{"error": %s}' % v) for i, v in enumerate(values)] + [(90, "{}"), (91, "[1]"), (92, '"error"')]
    df = spark.createDataFrame(rows, "id int, j string").select("id", strict_json(F.col("j")).alias("doc"))
    got = {r.id: (r.failed, r.successful) for r in trajectory_outcomes(df, ["id"]).collect()}
    assert got == {i: (n, 0) for i, n in enumerate(values.values())} | {90: (0, 0), 91: (0, 1), 92: (0, 0)}


def test_four_outcomes_of_an_evaluation(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    g = lambda n, f: os.path.join(root, "run_1", f"gen_{n}", f)
    trace = "Traceback (most recent call last):\n  File \"evaluate.py\", line 3, in <module>\n"
    write(g(1, "evaluation.log"), "fine")
    write(g(1, "results.json"), "{}")
    write(g(2, "evaluation.log"), "no results today")
    write(g(3, "target_agent.py"), "x")
    write(g(4, "evaluation.log"), trace + "ValueError: bad row\n")
    write(g(4, "results.json"), "{}")                    # left from before: it failed all the same
    write(g(5, "evaluation.log"), "evaluate.py exited with code 2")
    write(g(6, "evaluation.log"), trace + "ValueError: handled\ncontinuing\n")  # caught and printed
    write(g(6, "results.json"), "{}")
    write(g(7, "submission.csv"), "id,label\n")
    write(g(7, "late.txt"), "x")
    os.utime(g(7, "submission.csv"), (1_000_000, 1_000_000))
    os.utime(g(7, "late.txt"), (1_000_601, 1_000_601))
    write(g(8, "submission.csv"), "id,label\n")
    write(g(8, "late.txt"), "x")
    os.utime(g(8, "submission.csv"), (1_000_000, 1_000_000))
    os.utime(g(8, "late.txt"), (1_000_600, 1_000_600))   # not over the limit: may still run
    write(g(9, "evaluation.log"), "done, exit code 0")
    files = S.scan_runs(spark, root)
    got = {r.gen: (r.status, r.reason) for r in S.evaluation_outcome(spark, files, root).collect()}
    assert got == {1: ("success", None), 2: ("warning", "no results"), 3: ("skipped", "not run"), 4: ("error", "exit"), 5: ("error", "exit"),
                   6: ("success", None), 7: ("error", "timeout"), 8: ("skipped", "not run"), 9: ("warning", "no results")}
    assert {r.status for r in S.evaluation_outcome(spark, files, root, has_evaluator=False).collect()} == {"skipped"}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text('a,"\n\r x', max_size=25), min_size=8, max_size=30))
def test_csv_equals_pythons(spark, texts):
    """Any text: records and fields as Python's reader gives them."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.r for r in rows.select("i", F.transform(csv_records(F.col("t")), csv_fields).alias("r")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [r for r in csv.reader(io.StringIO(t, newline="")) if r], t


def test_quoted_label_submission(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_1", "gen_1", "submission.csv"), '"id","note, free",label\r\n1,"a, ""b""\nc",x\n2,,"y, z"\n\n3,"q",')
    got = sorted((r.id, r.pred_label) for r in label_submissions(spark, S.scan_runs(spark, root), root).collect())
    assert got == [(1, "x"), (2, "y, z"), (3, None)]


def test_flatten_rows(spark):
    doc = {"name": "meta", "model": {"id": "m1", "params": {"t": 0.5, "top": None}, "tags": ["a", "b"]},
           "empty": "", "n": 50.0, "ok": True, "none": None}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, j string").select("id", strict_json(F.col("j")).alias("d"))
    got = {r.key: r.value for r in flatten_rows(df, "d", ["id"]).collect()}
    assert got == {"name": "meta", "model.id": "m1", "model.params.t": "0.5", "model.tags": "a, b",
                   "n": "50", "ok": "true"}


def test_parse_percent_and_tail(spark):
    df = spark.createDataFrame([("48.99%",), (" 7 ",), ("abc",), ("1_000",), ("%",), (None,)], "s string")
    got = [r.v for r in df.select(parse_percent(F.col("s")).alias("v")).collect()]
    assert got == [48.99, 7.0, None, 1000.0, None, None]
    t = spark.createDataFrame([("\n".join(str(i) for i in range(12)),), ("a\nb",)], "s string")
    tails = [r.t for r in t.select(tail_lines(F.col("s")).alias("t")).collect()]
    assert tails == ["\n".join(str(i) for i in range(2, 12)), "a\nb"]


def test_evaluator_registry(spark):
    assert X.evaluators() == ["dice", "label", "multiple_choice", "open", "rmse", "roc_auc", "rouge_l", "silhouette"]
    truth = spark.createDataFrame([("t", 1, "A", "d", "s"), ("t", 2, "B", "d", "s")],
                                  "task string, question_id bigint, correct_answer string, domain string, subdomain string")
    answers = spark.createDataFrame([("t", 1, 1, 1, "a", 0)],
                                    "task string, run_id bigint, gen bigint, question_id bigint, answer string, pos bigint")
    graded, summary = X.evaluate("multiple_choice", answers, truth)
    s = summary.collect()[0]
    assert (s.total_questions, s.correct, s.missing, s.accuracy_percent) == (2, 1, 1, 100.0)
    metrics = {r.key: r.num for r in X.summary_metrics(summary).collect()}
    assert metrics["accuracy"] == 1.0 and metrics["missing"] == 1.0


def test_tool_call_pairing_and_outcomes(spark):
    msgs = spark.createDataFrame(
        [(1, 0, "assistant", None, [("c1", "function", ("search", '{"q": 1}'))], None),
         (1, 1, "tool", "result text", None, "c1"),
         (1, 2, "assistant", None, [("c2", "function", ("read", "{}"))], None)],
        "question_id int, turn int, role string, text string, "
        "tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>, "
        "tool_call_id string")
    pairs = sorted((r.call_id, r.tool, r.result) for r in tool_calls(msgs, ["question_id"]).collect())
    assert pairs == [("c1", "search", "result text"), ("c2", "read", None)]
    ex = spark.createDataFrame([(1, "[1]"), (1, '{"error": "File too large"}'), (1, '{"error": ""}'), (1, '"x"')],
                               "gen int, j string").select("gen", strict_json(F.col("j")).alias("doc"))
    o = trajectory_outcomes(ex, ["gen"]).collect()[0]
    assert (o["count"], o.successful, o.failed) == (4, 1, 1)


def test_block_text(spark):
    blocks = [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"cmd": "ls"}},
              {"type": "tool_result", "content": [{"type": "text", "text": "out"}]}, "plain", 5]
    df = spark.createDataFrame([(json.dumps(b),) for b in blocks], "j string")
    got = [r.t for r in df.select(block_text(strict_json(F.col("j"))).alias("t")).collect()]
    assert got == ["hi", '[tool_use: Bash]\n{"cmd":"ls"}', "[tool_result]\nout", "plain", "5"]


def test_outcome_events_and_sinks(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    g1 = os.path.join(root, "run_3", "gen_1")
    write(os.path.join(g1, "evaluation.log"), "ok")
    write(os.path.join(g1, "results.json"), json.dumps({"accuracy": 0.5}))
    write(os.path.join(root, "run_3", "gen_2", "evaluation.log"), "ran")
    write(os.path.join(root, "run_3", "gen_3", "target_agent.py"), "x")
    for s, names in (("s2", ["2.json", "1.json", "note.txt"]), ("s1", ["0.json"])):
        for n in names:
            write(os.path.join(g1, "openhands_trajectory", s, "events", n), json.dumps({"id": n}) if n != "1.json" else "[1]")
    files = S.scan_runs(spark, root)
    status = {r.gen: r.status for r in S.evaluation_outcome(spark, files, root).collect()}
    assert status == {1: "success", 2: "warning", 3: "skipped"}
    ev = [(r.session, r.event_file, r.ord) for r in S.agent_events(spark, files, root).orderBy("session", "ord").collect()]
    assert ev == [("s1", "0.json", 1), ("s2", "2.json", 1)]
    et = {r.gen: r.execution_type for r in S.execution_type(files).collect()}
    assert set(et.values()) == {"Single"}

    out = os.path.join(tmp_root, "eval")
    rows = spark.createDataFrame([(3, 1, 1, "correct"), (3, 2, 1, "missing")], "run_id int, gen int, q int, status string")
    K.write_eval(rows, out)
    K.write_eval(spark.createDataFrame([(3, 2, 1, "correct")], "run_id int, gen int, q int, status string"), out)
    back = sorted((r.run_id, r.gen, r.status) for r in spark.read.parquet(out).collect())
    assert back == [(3, 1, "correct"), (3, 2, "correct")]   # only generation 2 was replaced
    sub = os.path.join(tmp_root, "sub")
    K.write_submission(spark.createDataFrame([(3, 1, 5, "盗窃")], "run_id int, gen int, id bigint, pred_label string"), sub)
    got = spark.read.csv(sub, header=True).collect()
    assert [(r.id, r.label) for r in got] == [("5", "盗窃")]
    ing = K.ingest(spark, root, os.path.join(tmp_root, "ingested"))
    assert ing.where(F.col("rel_path") == "results.json").select("text").first().text == '{"accuracy": 0.5}'


def test_label_loaders(spark, tmp_root):
    truth = os.path.join(tmp_root, "test.csv")
    write(truth, "id,label\n1,盗窃\n2,诈骗\n")
    t = sorted((r.id, r.label) for r in load_truth_label(spark, truth, "law").collect())
    assert t == [(1, "盗窃"), (2, "诈骗")]
    pred = os.path.join(tmp_root, "predictions.csv")
    write(pred, "id,text,charge\n1,x,盗窃\n")
    p = load_label_submission(spark, pred).collect()
    assert [(r.id, r.pred_label) for r in p] == [(1, "盗窃")]
    df = spark.createDataFrame([(1, "a", "b")], "id int, label string, other string")
    assert resolve_label_column(df).columns == ["id", "pred_label", "other"]


def test_ordinal_matches_row_number_with_a_hot_group(spark):
    from pyspark.sql import Window

    from runlens.operators.sequence import ordinal

    # one group holds most rows: it must be split across partitions and still count 1..n
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(
        (F.col("id") % 10).cast("string")).alias("g"), F.col("id"))
    got = ordinal(df, ["g"], ["id"], partitions=8)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    diff = got.join(want, ["g", "id"]).where(F.col("ordinal") != F.col("rn")).count()
    assert diff == 0 and got.count() == 5000
    hot_parts = got.where(F.col("g") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot_parts > 1


def test_ordinal_with_wide_rows(spark):
    """Extra columns must not change the numbering (both reads see one partitioning)."""
    from pyspark.sql import Window

    from runlens.operators.sequence import ordinal

    df = spark.range(0, 20000).select((F.col("id") % 7).alias("g"), F.col("id"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("payload"),
                                      (F.col("id") * 3).alias("other"))
    got = ordinal(df, ["g"], ["id"], partitions=12)
    want = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("rn"))
    j = got.join(want, ["g", "id"])
    assert j.count() == 20000 and j.where(F.col("ordinal") != F.col("rn")).count() == 0


def test_preview_of_a_very_long_conversation(spark):
    from runlens.operators.trajectories import first_trajectories

    long_conv = [(1, 1, 10, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(2000)]
    short = [(1, 1, 2, 0, "user", "hello"), (1, 1, 3, 0, "user", "x")]
    df = spark.createDataFrame(long_conv + short, "run_id int, gen int, question_id int, turn int, role string, text string")
    rows = {r.question_id: r for r in first_trajectories(df, ["run_id", "gen"], "question_id").collect()}
    assert [rows[q].sample for q in (10, 2, 3)] == [1, 2, 3]        # lexicographic file names
    full = "\n".join(f"{'user' if t % 2 == 0 else 'assistant'}: t{t}" for t in range(2000))
    assert rows[10].messages == 2000
    assert rows[10].preview == full[:1000] + "\n  ... (truncated)"
    assert rows[2].preview == "user: hello"


def test_history_and_trajectory_sinks(spark, tmp_root):
    hist = os.path.join(tmp_root, "hist")
    K.write_history(spark.createDataFrame([(1, 1, 40.0), (1, 2, 50.0), (2, 1, 10.0)], "run_id int, gen int, acc double"),
                    hist)
    K.write_history(spark.createDataFrame([(1, 1, 41.0)], "run_id int, gen int, acc double"), hist)
    back = sorted((r.run_id, r.gen, r.acc) for r in spark.read.parquet(hist).collect())
    assert back == [(1, 1, 41.0), (2, 1, 10.0)]                    # run 1 replaced as a whole, run 2 kept
    tr = os.path.join(tmp_root, "traj")
    K.write_trajectories(spark.createDataFrame([(1, 1, 3, 0, "user", "q")],
                                               "run_id int, gen int, question_id int, turn int, role string, text string"), tr)
    assert spark.read.parquet(tr).count() == 1


def test_eval_document_layouts_round_trip(spark, tmp_root):
    from runlens.functions.json import accuracy_percent
    from runlens.operators import grading as G

    truth = spark.createDataFrame([("t", 1, "A", "Physics", "s"), ("t", 2, "B", "Bio", "s")],
                                  "task string, question_id bigint, correct_answer string, domain string, subdomain string")
    answers = spark.createDataFrame([("t", 1, 1, 1, "a", 0), ("t", 1, 2, 2, "c", 0)],
                                    "task string, run_id bigint, gen bigint, question_id bigint, answer string, pos bigint")
    summary = G.summarize_mc(truth, answers)
    details = G.grade_mc(truth, answers)
    path = os.path.join(tmp_root, "eval_mc")
    K.write_eval_documents(K.eval_documents(summary, details, "details"), path)
    back = K.read_eval_documents(spark, path)
    got = {r.gen: (r.pct, r.n) for r in back.select(
        "gen", accuracy_percent(F.col("doc")).alias("pct"),
        F.size(F.try_variant_get("doc", "$.details", "array<variant>")).alias("n")).collect()}
    assert got == {1: (100.0, 2), 2: (0.0, 2)}
    dom = {r.domain: (r.total, r.correct) for r in S.domain_stats_from_details(
        S.eval_details(back.where(F.col("gen") == 1))).collect()}
    assert dom == {"Physics": (1, 1), "Bio": (1, 0)}

    lt = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y")], "task string, id bigint, label string")
    la = spark.createDataFrame([("t", 1, 1, 1, "x")], "task string, run_id bigint, gen bigint, id bigint, pred_label string")
    merged = G.grade_label(lt, la)
    docs = K.eval_documents(G.summarize_label(merged), G.per_class(merged), "per_class")
    d = json.loads(docs.collect()[0].json)
    assert d["accuracy"] == 0.5 and d["n_correct"] == 1 and d["per_class"] == {"x": 1.0, "y": 0.0}

    nested = K.eval_documents(G.summarize_open(spark.createDataFrame(
        [("t", 1, 1, "q1", "CORRECT")], "task string, run_id bigint, gen bigint, question_id string, status string")),
        None, "nested")
    d = json.loads(nested.collect()[0].json)
    assert d["summary"]["accuracy_percent"] == 100.0 and d["results"] is None


def test_sinks_keep_names_that_share_an_index_apart(spark, tmp_root):
    """run_7 and run_07 are written by separate jobs; neither overwrites the other."""
    out = os.path.join(tmp_root, "named")
    rows = lambda run, gen, v: spark.createDataFrame([(run, 7, gen, 1, v)], "run_name string, run_id int, gen_name string, gen int, v int")
    for i, (run, gen) in enumerate([("run_7", "gen_1"), ("run_07", "gen_1"), ("run_7", "gen_01"), ("run_7", "gen_1")]):
        K.write_eval(rows(run, gen, i), out)
        K.write_history(rows(run, gen, i), out + "-h")
    assert {(r.run_name, r.gen_name, r.v) for r in spark.read.parquet(out).collect()} == {("run_7", "gen_1", 3), ("run_07", "gen_1", 1), ("run_7", "gen_01", 2)}
    assert {(r.run_name, r.v) for r in spark.read.parquet(out + "-h").collect()} == {("run_7", 3), ("run_07", 1)}
