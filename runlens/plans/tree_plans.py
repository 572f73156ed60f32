"""Plans over a runs tree: the data path of the improvement loop for every run
and generation in one job (scan -> metrics -> history -> finals -> overview).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.json import scalar_metrics
from ..functions.logs import insight_preview, insights, log_metrics_struct
from ..operators import history as H
from ..operators.sequence import first_per_group
from ..sources import tree as S

GEN = S.GEN            # (run_name, run_id, gen_name, gen): directory names are the keys
RUN = S.RUN            # (run_name, run_id)


def tree_metrics(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """A14 over a tree: ``results.json`` scalars, else ``detailed_results.json``
    scalars, else stdout-log regexes (first log name that exists)."""
    from ..functions.json import strict_json

    def named(names) -> DataFrame:
        return S.named_texts(spark, files, root, names).where(
            F.col("gen").isNotNull() & F.col("rel_path").isin(*names))

    docs = named(C.METRIC_SOURCE_NAMES).withColumn("doc", strict_json(F.col("text")))
    results = scalar_metrics(docs.where(F.col("rel_path") == C.METRIC_SOURCE_NAMES[0]), "doc", GEN)
    detailed = scalar_metrics(docs.where(F.col("rel_path") == C.METRIC_SOURCE_NAMES[1]), "doc", GEN)
    rank = F.array_position(F.array(*(F.lit(n) for n in C.STDOUT_LOG_NAMES)), F.col("rel_path"))
    logs = first_per_group(named(C.STDOUT_LOG_NAMES), GEN, [rank])
    m = logs.select(*GEN, log_metrics_struct(F.col("text")).alias("m"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col("m")[k].alias("num")) for k in C.LOG_METRIC_PATTERNS))
    log_rows = m.select(*GEN, F.inline(pairs)).where(F.col("num").isNotNull()).select(
        *GEN, "key", F.lit("float").alias("kind"), "num", F.col("num").cast("string").alias("str"))
    cols = [*GEN, "key", "kind", "num", "str"]
    tagged = None
    for prio, src in enumerate((results.select(*cols), detailed.select(*cols), log_rows.select(*cols)), start=1):
        t = src.withColumn("prio", F.lit(prio))
        tagged = t if tagged is None else tagged.unionByName(t)
    from pyspark.sql import Window

    best = F.min("prio").over(Window.partitionBy(*GEN))
    return tagged.withColumn("_b", best).where(F.col("prio") == F.col("_b")).drop("_b")


def tree_generations(spark: SparkSession, files: DataFrame, root: str, metrics: DataFrame) -> DataFrame:
    """One row per generation: code size and lines, execution type, accuracy."""
    gens = files.where(F.col("gen").isNotNull()).select(*GEN).distinct()
    stats = S.source_stats(spark, files.where(F.col("gen").isNotNull()), root)
    et = S.execution_type(files)
    acc = metrics.where(F.col("key") == "accuracy").select(*GEN, H.metric_value(metrics).alias("accuracy"))
    return gens.join(stats, GEN, "left").join(et, GEN, "left").join(acc, GEN, "left").fillna(
        {"size": 0, "lines": 0})


def tree_insights(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    name = C.TEXT_ARTIFACTS["improvement"]
    t = S.named_texts(spark, files, root, (name,)).where(F.col("gen").isNotNull() & (F.col("rel_path") == name))
    ex = t.select(*GEN, F.posexplode(insights(F.col("text"))).alias("p", "insight"))
    return ex.select(*GEN, (F.col("p") + 1).alias("pos"), "insight", insight_preview(F.col("insight")).alias("preview"),
                     (F.col("p") < C.INSIGHTS_SHOWN).alias("shown"))


def run_overview(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """A6 + S11 + J8 + A7 + S7: one nested row per run, newest id first.

    ``files``: the ingested table (``sinks.ingest``) to read instead of the tree."""
    files = files if files is not None else S.scan_runs(spark, root)
    runs = files.select(*RUN).distinct()
    ctx = S.parse_context(spark, files, root).drop("entries")
    ev = S.eval_summaries(spark, files, root).drop("doc", "details")
    traj = S.trajectory_ids(files)
    art = S.artifact_matrix(files)
    gens = files.where(F.col("gen").isNotNull()).select(*GEN).distinct()
    g = gens.join(ev, GEN, "left").join(art, GEN, "left").join(traj, GEN, "left")
    g = g.withColumn("num_trajectories", F.coalesce(F.size("trajectories"), F.lit(0)))
    nested = g.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("num_generations"),
        F.max("accuracy_percent").alias("best_accuracy_percent"),
        F.array_sort(F.collect_list(F.struct(*[c for c in g.columns if c not in RUN]))).alias("generations"),
    )
    out = runs.join(ctx, RUN, "left").join(nested, RUN, "left").fillna(0, ["num_generations"])
    return out.orderBy(F.col("run_id").desc())


def run_history(spark: SparkSession, root: str, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """K4 content: generations with deltas, metric deltas, insights and finals."""
    files = files if files is not None else S.scan_runs(spark, root)
    metrics = tree_metrics(spark, files, root)
    gens = tree_generations(spark, files, root, metrics)
    growth = H.code_growth(gens.select(*GEN, "size", "lines"), run=RUN)
    finals = H.run_finals(gens.select(*GEN, "accuracy"), run=RUN)
    first_last = gens.groupBy(*RUN).agg(
        (F.max_by("lines", "gen") - F.min_by("lines", "gen")).alias("lines_growth"),
        (F.max_by("size", "gen") - F.min_by("size", "gen")).alias("size_growth"))
    finals = finals.join(first_last, RUN)
    return {
        "generations": gens.join(growth.drop("size", "lines"), RUN + ["gen"], "left"),
        "metrics": metrics,
        "deltas": H.metric_deltas(metrics, run=RUN),
        "comparison": H.metric_comparison(metrics, run=RUN),
        "insights": tree_insights(spark, files, root),
        "finals": finals,
    }


def label_leaderboard(spark: SparkSession, root: str, truth: DataFrame, task: str,
                      files: DataFrame | None = None) -> DataFrame:
    """T-6 over a tree: every generation of every run graded against the label
    truth (A2), best first within a run; a generation whose submission cannot be
    read is an error row with ``bad_reason`` instead of a score."""
    from ..operators import grading as G
    from ..sources.artifacts import label_submissions

    files = files if files is not None else S.scan_runs(spark, root)
    subs = label_submissions(spark, files, root).withColumn("task", F.lit(task))
    # Grade on keys derived from the directory names (T27: run_7 and run_07 stay
    # apart), then restore the names and indexes.
    names = subs.select(*GEN).distinct().select(
        *GEN, F.xxhash64("run_name").alias("_rk"), F.xxhash64("run_name", "gen_name").alias("_gk"))
    keyed = subs.join(names, GEN).select("task", F.col("_rk").alias("run_id"), F.col("_gk").alias("gen"),
                                         "id", "pred_label", "bad_reason")
    ok = keyed.where(F.col("bad_reason").isNull())
    gens = ok.select("task", "run_id", "gen").distinct()
    scores = G.summarize_label(G.grade_label(truth.withColumn("task", F.lit(task)), ok, gens))
    errors = keyed.where(F.col("bad_reason").isNotNull()).select(
        "task", "run_id", "gen", F.lit(None).cast("double").alias("accuracy"),
        F.lit(None).cast("bigint").alias("n_correct"), F.lit(None).cast("bigint").alias("n_total"), "bad_reason")
    board = scores.withColumn("bad_reason", F.lit(None).cast("string")).unionByName(errors) \
        .withColumnRenamed("run_id", "_rk").withColumnRenamed("gen", "_gk").join(names, ["_rk", "_gk"]) \
        .drop("_rk", "_gk")
    return H.leaderboard(board, partition=["task", *RUN])
