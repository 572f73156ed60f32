"""Streaming: batch = stream after the last trigger, re-delivery, stop marker."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from runlens import session
from runlens.operators.history import run_summary
from runlens.session import state_location
from runlens.sources import tree as S
from runlens.streaming import history
from runlens.streaming import live as L
from runlens.streaming.history import HistoryTable
from runlens.streaming.processors import HELD_ROWS, PROVIDER_CONF, EarlyStop


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _eval(root, run, gen, acc, name="evaluation_results.json"):
    write(os.path.join(root, f"run_{run}", f"gen_{gen}", name), json.dumps({"accuracy_percent": acc}))


def _batch_board(spark, root):
    files = S.scan_runs(spark, root)
    ev = S.eval_summaries(spark, files, root).select("run_name", "gen", F.col("accuracy_percent").alias("accuracy"))
    return {r.run_name: (r.num_generations, r.best_accuracy)
            for r in run_summary(ev.withColumnRenamed("run_name", "run_id")).withColumnRenamed("run_id", "run_name").collect()}


def _live_board(spark, table):
    out = {}
    for r in spark.sql(f"SELECT * FROM {table} ORDER BY version").collect():
        out[r.run_name] = (r.num_generations, r.best_accuracy)
    return out


def test_live_leaderboard_equals_batch(spark, tmp_root):
    """After every trigger, files of either name in any order: the stream says what the batch says."""
    root = os.path.join(tmp_root, "runs")
    steps = [
        [(1, 1, 40.0, "evaluation_results.json"), (2, 1, 10.0, "evaluation_results.json")],
        [(1, 2, 55.0, "evaluation_results.json"), (2, 2, 5.0, "results.json")],
        [(1, 2, 90.0, "results.json")],                       # second by priority: does not count
        [(3, 1, 90.0, "results.json"), (3, 2, 30.0, "results.json")],
        [(3, 1, 40.0, "evaluation_results.json")],            # replaces the best: the best falls
        [(4, 1, None, "evaluation_results.json"), (4, 1, 60.0, "results.json"), (4, 2, 1.0, "results.json")],
    ]
    _eval(root, 9, 1, 1.0)
    ckpt = state_location(spark, f"st1-{os.path.basename(tmp_root)}")

    def start():
        gens = L.evaluated_generations(L.tree_stream(spark, root))
        return (L.live_leaderboard(gens).writeStream.outputMode("update").foreachBatch(
            lambda df, i: df.write.mode("append").parquet(os.path.join(tmp_root, "board"))).option("checkpointLocation", ckpt).start())

    q = start()
    try:
        for i, step in enumerate(steps):
            for run, gen, acc, name in step:
                _eval(root, run, gen, acc, name)
            q.processAllAvailable()
            if i == 3:  # a restart goes on from the stored state
                q.stop()
                q = start()
            spark.read.parquet(os.path.join(tmp_root, "board")).createOrReplaceTempView("st1_board")
            assert _live_board(spark, "st1_board") == _batch_board(spark, root)
    finally:
        q.stop()
    assert _batch_board(spark, root) == {"run_1": (2, 55.0), "run_2": (2, 10.0), "run_3": (2, 40.0), "run_4": (2, 1.0), "run_9": (1, 1.0)}


def test_state_needs_the_disk_store(spark, tmp_root):
    before = spark.conf.get(PROVIDER_CONF)
    spark.conf.set(PROVIDER_CONF, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            L.early_stop(L.tree_stream(spark, tmp_root))
    finally:
        spark.conf.set(PROVIDER_CONF, before)


def test_log_metric_stream(spark, tmp_root):
    logs = os.path.join(tmp_root, "logs")
    write(os.path.join(logs, "a.log"), "epoch 1\nAccuracy: 48.5%\n12/20 correct\n")
    ckpt = state_location(spark, f"st2-{os.path.basename(tmp_root)}")
    q = (L.log_metric_stream(spark, logs).writeStream.format("memory").queryName("st2_lines")
         .option("checkpointLocation", ckpt).start())
    try:
        q.processAllAvailable()
        write(os.path.join(logs, "b.log"), "val=0.75\n")
        q.processAllAvailable()
        rows = spark.sql("SELECT * FROM st2_lines").collect()
    finally:
        q.stop()
    got = sorted((r.line, r.accuracy, r.correct, r.validation) for r in rows)
    assert got == [("12/20 correct", None, 12.0, None), ("Accuracy: 48.5%", 48.5, None, None),
                   ("val=0.75", None, None, 0.75)]


def _stop_query(spark, root, tmp_root, ckpt, idle_after_ms=None):
    out = os.path.join(tmp_root, "flags")
    return (L.early_stop(L.tree_stream(spark, root), idle_after_ms).writeStream.outputMode("append").foreachBatch(
        lambda df, i: df.write.mode("append").parquet(out)).option("checkpointLocation", ckpt).start())


def _flags(spark, tmp_root):
    rows = spark.read.parquet(os.path.join(tmp_root, "flags")).collect()
    return sorted((r.run_id, r.gen, r.name, r.status) for r in rows if r.status != "idle")


def test_early_stop_marker_across_a_restart(spark, tmp_root):
    root = os.path.join(tmp_root, "runs")
    write(os.path.join(root, "run_1", "gen_1", "target_agent.py"), "x")
    ckpt = state_location(spark, f"st3-{os.path.basename(tmp_root)}")
    q = _stop_query(spark, root, tmp_root, ckpt)
    try:
        q.processAllAvailable()
        write(os.path.join(root, "run_1", "gen_2", "COMPLETED"), "done")
        q.processAllAvailable()
        q.stop()
        write(os.path.join(root, "run_1", "gen_2", "target_agent.py"), "late")
        write(os.path.join(root, "run_1", "gen_3", "target_agent.py"), "late")
        write(os.path.join(root, "run_2", "gen_5", "target_agent.py"), "other run")
        q = _stop_query(spark, root, tmp_root, ckpt)
        q.processAllAvailable()
    finally:
        q.stop()
    assert _flags(spark, tmp_root) == [
        (1, 1, "target_agent.py", "ok"), (1, 2, "COMPLETED", "stop"), (1, 2, "target_agent.py", "after_stop"),
        (1, 3, "target_agent.py", "after_stop"), (2, 5, "target_agent.py", "ok")]


def test_a_marker_counts_for_its_whole_batch(spark, tmp_root):
    """One batch with the marker anywhere in it; a run that goes idle."""
    root = os.path.join(tmp_root, "runs")
    for gen in range(1, 7):
        for f in range(3):
            write(os.path.join(root, "run_1", f"gen_{gen}", f"f{f}"), "x")
            write(os.path.join(root, "run_2", f"gen_{gen}", f"f{f}"), "x")
    write(os.path.join(root, "run_1", "gen_4", "COMPLETED"), "x")
    write(os.path.join(root, "run_1", "gen_6", "COMPLETED"), "x")
    ckpt = state_location(spark, f"st3b-{os.path.basename(tmp_root)}")
    # with timers a query is never done: wait for its rows instead
    q = _stop_query(spark, root, tmp_root, ckpt, idle_after_ms=1500)
    rows = []
    try:
        for _ in range(60):
            time.sleep(0.5)
            if glob.glob(os.path.join(tmp_root, "flags", "*.parquet")):
                rows = spark.read.parquet(os.path.join(tmp_root, "flags")).collect()
            if any(r.status == "idle" for r in rows):
                break
    finally:
        q.stop()
    got = _flags(spark, tmp_root)
    assert [x for x in got if x[0] == 1 and x[3] == "after_stop"] == [(1, g, f"f{f}", "after_stop") for g in (4, 5, 6) for f in range(3)]
    assert sum(x[3] == "ok" for x in got) == 9 + 18 and sum(x[3] == "stop" for x in got) == 2
    assert {r.run_id for r in rows if r.status == "idle"} == {2}  # the stopped run has no timer


class _Store:
    """State of one key, for a processor without a query."""

    def __init__(self):
        self.value, self.rows, self.most = None, [], 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if not self.rows else iter(self.rows)

    def update(self, v):
        self.value = v

    def appendList(self, rows):
        self.most = max(self.most, len(rows))
        self.rows += rows

    def clear(self):
        self.rows = []


def test_a_run_of_a_million_files_in_one_batch():
    """Undecided rows go to state in blocks; memory does not follow the batch."""
    from pyspark.sql import Row

    p = EarlyStop()
    p.stop, p.waiting = _Store(), _Store()
    n = 1_000_000
    rows = (Row(gen=i % 100, name="COMPLETED" if i == n - 1 else "f") for i in range(n))
    counts = {}
    for r in p.handleInputRows(("run_1", 1), rows, None):
        counts[r.status] = counts.get(r.status, 0) + 1
    assert counts == {"stop": 1, "ok": n - n // 100, "after_stop": n // 100 - 1}
    assert p.waiting.most == HELD_ROWS and not p.waiting.rows and p.stop.value == (99,)


def _gens(spark, rows):
    return spark.createDataFrame(rows, "run_name string, run_id int, gen_name string, gen int, accuracy double")


def _row(run, gen, acc=1.0):
    return (f"run_{run}", run, f"gen_{gen}", gen, acc)


def _held(table, spark):
    return sorted((r.run_id, r.gen) for r in table.read(spark).collect())


def test_history_sink_is_idempotent(spark, tmp_root):
    root, table = os.path.join(tmp_root, "runs"), os.path.join(tmp_root, "history")
    _eval(root, 1, 1, 40.0)
    ckpt = state_location(spark, f"st4-{os.path.basename(tmp_root)}")
    gens = L.evaluated_generations(L.tree_stream(spark, root)).select("run_id", "gen", "accuracy")
    q = gens.writeStream.foreachBatch(L.history_sink(table)).option("checkpointLocation", ckpt).start()
    try:
        q.processAllAvailable()
        _eval(root, 1, 2, 50.0)
        q.processAllAvailable()
        _eval(root, 1, 2, 50.0, name="results.json")   # re-delivery of generation 2
        q.processAllAvailable()
    finally:
        q.stop()
    assert _held(HistoryTable(table, ["run_id", "gen"]), spark) == [(1, 1), (1, 2)]
    hist = {r.gen: (r.delta, r.best_so_far) for r in L.read_history(spark, table).collect()}
    assert hist == {1: (None, 40.0), 2: (10.0, 50.0)}


def test_failure_between_write_and_commit(spark, tmp_root, monkeypatch):
    table = HistoryTable(os.path.join(tmp_root, "history"), ["run_name", "gen_name"])
    assert table.read(spark) is None
    table.append(_gens(spark, [_row(1, 1)]), 0)
    with monkeypatch.context() as m:
        m.setattr(HistoryTable, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.append(_gens(spark, [_row(1, 2), _row(9, 9)]), 1)
    assert os.path.isdir(os.path.join(table.path, "batch=1"))
    assert _held(table, spark) == [(1, 1)]                         # written, not committed
    table.append(_gens(spark, [_row(1, 2), _row(1, 1)]), 1)        # delivered again, with other rows
    assert _held(table, spark) == [(1, 1), (1, 2)]
    table.append(_gens(spark, [_row(1, 2), _row(1, 1)]), 1)        # committed, but the stream did not learn it
    assert _held(table, spark) == [(1, 1), (1, 2)]


def test_a_failing_read_is_not_a_first_batch(spark, tmp_root):
    table = HistoryTable(os.path.join(tmp_root, "history"), ["run_name", "gen_name"])
    table.append(_gens(spark, [_row(1, 1)]), 0)
    manifest = os.path.join(table.path, "_manifest", "batch=0")
    for f in os.listdir(manifest):
        if f.endswith(".parquet"):
            write(os.path.join(manifest, f), "not a parquet file")
        elif f.endswith(".crc"):
            os.remove(os.path.join(manifest, f))
    with pytest.raises(Exception):
        table.append(_gens(spark, [_row(1, 1)]), 1)
    assert not os.path.exists(os.path.join(table.path, "batch=1"))


def test_compaction_pruning_and_vacuum(spark, tmp_root, monkeypatch):
    table = HistoryTable(os.path.join(tmp_root, "history"), ["run_name", "gen_name"], compact_after=3)
    read = []
    load = HistoryTable._load
    monkeypatch.setattr(HistoryTable, "_load", lambda self, s, folders, schema=None: (schema is not None and read.append(folders), load(self, s, folders, schema))[1])
    want = set()
    for i in range(11):
        rows = [_row(i, 1), _row(i, 2)] + ([_row(i - 1, 2)] if i else [])
        want |= {r[1:4:2] for r in rows}
        table.append(_gens(spark, rows), i)
        assert _held(table, spark) == sorted(want)
    # a batch is compared only with the folder that holds the generation delivered again
    assert len(read) == 10 and all(len(f) <= 2 for f in read)
    folders = {r.folder: (r.level, r.n) for r in table.folders(spark).collect()}
    assert len(folders) == 3 and sum(n for _, n in folders.values()) == 22 and max(lv for lv, _ in folders.values()) == 2
    gone = table.vacuum(spark, keep=1)
    assert gone and sorted(f for f in os.listdir(table.path) if "=" in f) == sorted(folders)
    assert _held(table, spark) == sorted(want)
    monkeypatch.setattr(history, "FILTER_KEYS", 1)  # folders without a filter are always compared
    table.append(_gens(spark, [_row(50, 1), _row(50, 2)]), 11)
    table.append(_gens(spark, [_row(50, 1), _row(0, 1)]), 12)
    assert _held(table, spark) == sorted(want | {(50, 1), (50, 2)})


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
