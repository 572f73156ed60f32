"""Stateful processors of the live operators (ST1, ST3).

State lives in the RocksDB store of the executors, checkpointed to the query's shared
checkpoint folder, so its size is bounded by disk and a restarted query goes on where it
stopped.  Rows are handled one at a time; nothing gathers a run's files of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from .. import config as C

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one run that are held in memory while it is open whether they come after a stop.
HELD_ROWS = 10_000

BOARD_OUTPUT = "run_name string, run_id int, num_generations long, best_accuracy double, version long"
STOP_OUTPUT = "run_name string, run_id int, gen int, name string, status string"


def needs_disk_state(spark: SparkSession) -> None:
    """Map, list and timer state need the RocksDB store, which the session chooses."""
    if not spark.conf.get(PROVIDER_CONF, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"this operator keeps its state on disk: set {PROVIDER_CONF} to {ROCKSDB}")


class Leaderboard(StatefulProcessor):
    """ST1: per run a map from generation to (file rank, time, accuracy).

    A generation's accuracy is that of its result file of first rank, whatever the order of
    arrival; of the same file delivered again, the newest counts.  A better file may lower
    a run's best accuracy; only then is the run's map read through.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.generations = handle.getMapState("generations", "gen_name string", "file_rank int, mtime timestamp, accuracy double")
        self.total = handle.getValueState("total", "num long, best double, version long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        num, best, version = self.total.get() if self.total.exists() else (0, None, 0)
        stale = False
        for row in rows:
            at = (row.gen_name,)
            old = self.generations.getValue(at) if self.generations.containsKey(at) else None
            if old is not None and (row.file_rank, -row.mtime.timestamp()) > (old[0], -old[1].timestamp()):
                continue
            self.generations.updateValue(at, (row.file_rank, row.mtime, row.accuracy))
            num += old is None
            if row.accuracy is not None and (best is None or row.accuracy >= best):
                best = row.accuracy
            elif old is not None and old[2] is not None and old[2] == best:
                stale = True  # what may have been the best is replaced by less
        if stale:
            best = max((v[2] for v in self.generations.values() if v[2] is not None), default=None)
        self.total.update((num, best, version + 1))
        yield Row(run_name=key[0], run_id=key[1], num_generations=num, best_accuracy=best, version=version + 1)

    def close(self) -> None:
        pass


class EarlyStop(StatefulProcessor):
    """ST3: a marker in generation g stops the run after g - 1.

    Files of generations >= g are ``after_stop`` if they come in the marker's batch or later,
    all others ``ok``.  While a batch may still bring a marker, undecided rows wait: the
    first ``HELD_ROWS`` in memory, the others in list state on disk.  A run that was not
    stopped and has had no file for ``idle_after_ms`` gives one ``idle`` row, by a timer that
    every file of the run puts off.
    """

    def __init__(self, idle_after_ms: int | None = None):
        self.idle_after_ms = idle_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stop = handle.getValueState("stop", "gen int")
        self.waiting = handle.getListState("waiting", "gen int, name string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        stop = self.stop.get()[0] if self.stop.exists() else None
        held: list[tuple] = []
        on_disk = False

        def flagged(gen: int, name: str, status: str) -> Row:
            return Row(run_name=key[0], run_id=key[1], gen=gen, name=name, status=status)

        for row in rows:
            if row.name == C.COMPLETED_MARKER:
                stop = row.gen if stop is None else min(stop, row.gen)
                yield flagged(row.gen, row.name, "stop")
            elif stop is not None and row.gen >= stop:
                yield flagged(row.gen, row.name, "after_stop")
            else:
                held.append((row.gen, row.name))
                if len(held) >= HELD_ROWS:
                    self.waiting.appendList(held)
                    held, on_disk = [], True
        if on_disk:
            for gen, name in self.waiting.get():
                yield flagged(gen, name, "after_stop" if stop is not None and gen >= stop else "ok")
            self.waiting.clear()
        for gen, name in held:
            yield flagged(gen, name, "after_stop" if stop is not None and gen >= stop else "ok")
        if stop is not None:
            self.stop.update((stop,))
        if self.idle_after_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if stop is None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_after_ms)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(run_name=key[0], run_id=key[1], gen=None, name=None, status="idle")

    def close(self) -> None:
        pass
