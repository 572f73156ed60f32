"""Sinks (K1-K4) and the one-pass tree ingest.

All sinks write partitioned tables with *dynamic* partition overwrite, so
re-grading a generation (or re-writing a run's history) replaces exactly the
partitions present in the new data and nothing else.  Writes go through
Spark's committer: a task lost mid-write is retried without leaving partial
output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .tree import FILES_COLUMNS, _layout, binary_files


def _overwrite_partitions(df: DataFrame, path: str, cols: list[str], fmt: str = "parquet", **options) -> None:
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols)
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(path)


def _by(df: DataFrame, level: str) -> list[str]:
    """Partition columns of a run or generation: the directory names where the table has
    them, since indexes may be shared (T27), else the indexes."""
    if level == "run":
        return ["run_name"] if "run_name" in df.columns else ["run_id"]
    return ["run_name", "gen_name"] if {"run_name", "gen_name"} <= set(df.columns) else ["run_id", "gen"]


def write_eval(graded: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: per-question evaluation rows (and/or summaries), one partition per generation."""
    _overwrite_partitions(graded, path, _by(graded, "gen"), fmt)


def write_submission(preds: DataFrame, path: str) -> None:
    """K2: ``id,label`` CSV with a header, one folder per generation."""
    keys = _by(preds, "gen")
    _overwrite_partitions(preds.select(*keys, "id", F.col("pred_label").alias("label")), path, keys, "csv", header="true")


def write_trajectories(turns: DataFrame, path: str) -> None:
    """K3: trajectories as one partitioned table, not one file per question."""
    _overwrite_partitions(turns, path, _by(turns, "gen"))


def write_history(history: DataFrame, path: str) -> None:
    """K4: one row per generation plus the run finals, partitioned by run."""
    _overwrite_partitions(history, path, _by(history, "run"))


def ingest(spark: SparkSession, root: str, out: str, max_bytes: int = C.MAX_EXECUTION_LOG_SIZE) -> DataFrame:
    """Scan a runs tree once and keep every file row (text for files under the
    largest cap any reader uses) as parquet partitioned by ``run_id``.

    The result is a ``files`` table carrying ``text``: pass it to the tree
    readers and plans (``files=``) and they filter it instead of listing and
    reading the tree again.  Partitioning by run (not by generation) keeps
    partitions few and large.
    """

    raw = binary_files(spark, root)
    ok = raw.where(F.col("length") <= max_bytes)
    big = raw.where(F.col("length") > max_bytes).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    laid = _layout(ok.unionByName(big), root, extra=("content",))
    rows = laid.select(*FILES_COLUMNS, F.decode("content", "UTF-8").alias("text"),
                       F.when(F.col("length") > max_bytes, F.lit("TOO_LARGE")).alias("bad_reason"))
    # rebalanced, not repartitioned: a run of any size is written by as many tasks as it fills
    _overwrite_partitions(rows.hint("rebalance", "run_id"), out, ["run_id"])
    return spark.read.parquet(out)


# --------------------------------------------------------------------------- #
# K1 layouts: one evaluation document per generation
# --------------------------------------------------------------------------- #
GEN = ["run_id", "gen"]


def eval_documents(summary: DataFrame, details: DataFrame | None, layout: str) -> DataFrame:
    """K1: one JSON evaluation document per generation, in one of three layouts.

    * ``details``  -- the summary's fields at the top level plus a ``details`` array
      (multiple choice);
    * ``per_class`` -- the summary's fields plus a ``per_class`` object
      label -> accuracy (labels); ``details`` are per-class rows;
    * ``nested``   -- ``{"summary": {...}, "results": [...]}`` (open answers).

    A generation's detail rows are bounded by its truth set, so gathering them
    into one document is a bounded collect.
    """
    fields = [c for c in summary.columns if c not in GEN and c != "task"]
    s = summary.select(*GEN, F.struct(*fields).alias("_s"))
    if details is None:
        d = s.select(*GEN).withColumn("_d", F.lit(None))
    elif layout == "per_class":
        d = details.groupBy(*GEN).agg(F.map_from_entries(F.collect_list(F.struct("label", "accuracy"))).alias("_d"))
    else:
        cols = [c for c in details.columns if c not in GEN and c != "task"]
        order = "question_id" if "question_id" in cols else cols[0]
        d = details.groupBy(*GEN).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
                                      .alias("_d"))
    j = s.join(d, GEN, "left")
    if layout == "nested":
        doc = F.struct(F.col("_s").alias("summary"), F.col("_d").alias("results"))
    elif layout in ("details", "per_class"):
        doc = F.struct(*[F.col("_s")[f].alias(f) for f in fields], F.col("_d").alias(layout))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    # Python writes null fields; keep them.
    return j.select(*GEN, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def write_eval_documents(docs: DataFrame, path: str) -> None:
    """K1: the documents as JSON text, one partition folder per generation."""
    _overwrite_partitions(docs.select(*GEN, "json"), path, GEN, "text")


def read_eval_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read K1 documents back as VARIANT, ready for the tree readers' functions."""
    from ..functions.json import strict_json

    return spark.read.text(path).select(*GEN, strict_json(F.col("value")).alias("doc"))
