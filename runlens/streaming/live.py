"""Structured Streaming over a runs tree that is still being written (ST1-ST4).

The tree is read with the file-stream source (``binaryFile`` with an explicit
schema): every micro-batch sees only files that landed since the last one, and
the source's own log makes a restarted query resume where it stopped.  State
and checkpoints live under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.json import accuracy_percent, strict_json
from ..functions.logs import log_metrics_struct
from ..operators.segments import Segments
from ..sources.tree import BINARY_FILE_SCHEMA, _layout
from .history import HistoryTable
from .processors import BOARD_OUTPUT, STOP_OUTPUT, EarlyStop, Leaderboard, needs_disk_state

# Directory names are the keys (T27); the indexes ride along.
GEN = ["run_name", "run_id", "gen_name", "gen"]
RUN = ["run_name", "run_id"]


def tree_stream(spark: SparkSession, root: str, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a runs tree as a stream of ``files`` rows (+ ``content``)."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _layout(r.load(root), root, extra=("content",))


def evaluated_generations(stream: DataFrame) -> DataFrame:
    """Generation records from evaluation summaries as they land."""
    ev = stream.where(F.col("gen").isNotNull() & F.col("rel_path").isin(*C.EVAL_RESULT_NAMES))
    doc = strict_json(F.decode(F.col("content"), "UTF-8"))
    return ev.select(*GEN, "rel_path", "mtime", accuracy_percent(doc).alias("accuracy"))


def live_leaderboard(generations: DataFrame) -> DataFrame:
    """ST1: per run, evaluated generations and best accuracy, kept current.

    A generation's accuracy is that of its result file of first priority (S4), so the
    stream agrees with the batch summary (A6) in whatever order files arrive or arrive
    again.  (The file source gives a path once: a file rewritten in place is not seen again.)
    Each batch gives a row per run that had files; the one of greatest ``version`` is current.
    """
    needs_disk_state(generations.sparkSession)
    rank = F.array_position(F.array(*(F.lit(n) for n in C.EVAL_RESULT_NAMES)), F.col("rel_path")).cast("int")
    rows = generations.select(*RUN, "gen_name", rank.alias("file_rank"), "mtime", "accuracy")
    return rows.groupBy(*RUN).transformWithState(Leaderboard(), BOARD_OUTPUT, "Update", "None")


def log_metric_stream(spark: SparkSession, logs_dir: str) -> DataFrame:
    """ST2: stdout lines as they are written -> per-line metric values."""
    lines = spark.readStream.format("text").load(logs_dir).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    m = lines.select("path", "line", log_metrics_struct(F.col("line")).alias("m"))
    any_metric = F.lit(False)
    for k in C.LOG_METRIC_PATTERNS:
        any_metric = any_metric | F.col(k).isNotNull()
    return m.select("path", "line", "m.*").where(any_metric)


def early_stop(stream: DataFrame, idle_after_ms: int | None = None) -> DataFrame:
    """ST3: flag files by whether their run had already been stopped; with ``idle_after_ms``, also
    runs that have had no file for that long (see ``processors.EarlyStop``)."""
    needs_disk_state(stream.sparkSession)
    rows = stream.where(F.col("gen").isNotNull()).select(*RUN, "gen", F.col("rel_path").alias("name"))
    time = "None" if idle_after_ms is None else "ProcessingTime"
    return rows.groupBy(*RUN).transformWithState(EarlyStop(idle_after_ms), STOP_OUTPUT, "Append", time)


def history_sink(table_path: str, keys: list[str] | None = None, compact_after: int = 16):
    """ST4: a ``foreachBatch`` function that appends each finished generation once, whatever is
    delivered again (see ``history.HistoryTable``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        HistoryTable(table_path, keys or [c for c in GEN if c in batch.columns], compact_after).append(batch, batch_id)

    return write


def read_history(spark: SparkSession, table_path: str) -> DataFrame:
    """The appended history: each generation with its delta to the previous
    generation of the run and the running best (one segmented scan, so a run of any length
    is spread over tasks)."""
    h = HistoryTable(table_path, []).read(spark)
    if h is None:
        raise ValueError(f"no history was committed to {table_path}")
    keys = [c for c in GEN if c in h.columns]
    run = [c for c in RUN if c in keys]
    names = [c for c in keys if c == "gen_name"]  # T27: indexes may be shared
    scanned = Segments.of(h.select(*keys, "accuracy"), run, ["gen", *names]).scan(
        previous={"prev_accuracy": "accuracy"}, best={"best_so_far": "accuracy"})
    return scanned.select(*keys, "accuracy", "prev_accuracy", F.round(F.col("accuracy") - F.col("prev_accuracy"), 6).alias("delta"), "best_so_far")
