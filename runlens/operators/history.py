"""Generation history: runs, finals, deltas, comparisons, series (A6, A11, A14,
W1-W5, U1, T-1, T-5, T-6).

Inputs:

* ``generations`` (run_id, gen, accuracy DOUBLE[, success BOOLEAN])
* ``metrics``     long rows (run_id, gen, key, num DOUBLE[, str STRING, kind STRING])

A run may hold any share of all rows, so nothing here sorts a run in one task: running and
previous values are segmented scans (``segments``), best and last generations are grouped
aggregates combined before their exchange, and ranks are distributed row numbers.  The
operators that scan take a table or ``Segments`` of the run in the order of ``gen``, so
several of them can share one cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import parse_percent
from .segments import Segments, plain, segments
from .sequence import ordinal

RUN = ["run_id"]


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


def metric_value(df: DataFrame) -> Column:
    """Numeric value of a metric row: numbers pass, bools are 0/1, strings go
    through the percent parser (P9); anything else is NULL."""
    cols = set(df.columns)
    num = F.col("num") if "num" in cols else F.lit(None).cast("double")
    if "str" in cols:
        kind = F.col("kind") if "kind" in cols else F.lit(None)
        from_str = F.when(kind.isNull() | (kind == "string"), parse_percent(F.col("str")))
        return F.coalesce(num, from_str)
    return num


def run_summary(generations: DataFrame | Segments, runs: DataFrame | None = None) -> DataFrame:
    """Generation count and best accuracy (NULLs ignored) per run."""
    agg = plain(generations).groupBy(*RUN).agg(
        F.count(F.lit(1)).cast("bigint").alias("num_generations"),
        F.max("accuracy").alias("best_accuracy"),
    )
    if runs is not None:
        agg = runs.select(*RUN).join(agg, RUN, "left").fillna(0, ["num_generations"])
    return agg


def runs_newest_first(summary: DataFrame) -> DataFrame:
    """T-1: runs ordered by id, newest first."""
    return summary.orderBy(F.col("run_id").desc())


def run_finals(generations: DataFrame | Segments, run: list[str] | None = None) -> DataFrame:
    """Totals, best generation (strict > so the earliest tie wins), first to
    last accuracy change.  Generations without a metric never become "best".

    Rows are first summed by (run, accuracy), which spreads a hot run, then by run: an accuracy
    is then one row of its run, so ``max_by`` meets no ties.  Hash aggregates only, both
    combined before their exchange.
    """
    generations = plain(generations)
    success = F.coalesce(F.col("success"), F.lit(True)) if "success" in generations.columns else F.lit(True)
    run = run or RUN
    by_value = generations.groupBy(*run, "accuracy").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(success).alias("_ok"), F.min("gen").alias("_from"), F.max("gen").alias("_to"))
    acc = F.col("accuracy")
    return by_value.groupBy(*run).agg(
        F.sum("_n").cast("bigint").alias("total_generations"),
        F.sum("_ok").cast("bigint").alias("successful_generations"),
        F.min("_from").alias("first_gen"),
        F.max("_to").alias("last_gen"),
        F.max_by("_from", acc).alias("best_gen"),
        F.max(acc).alias("best_accuracy"),
        F.min_by(acc, "_from").alias("first_accuracy"),
        F.max_by(acc, "_to").alias("last_accuracy"),
    ).withColumn("accuracy_gain", _r(F.col("last_accuracy") - F.col("first_accuracy")))


def accuracy_series(generations: DataFrame | Segments) -> DataFrame:
    """(gen, accuracy) points per run and the chart's upper bound
    ``max(50, max accuracy of the run)`` (an aggregate joined back; the points of a hot run
    are on the side that Spark may split)."""
    generations = plain(generations)
    top = generations.groupBy(*[F.col(c).alias(f"_{c}") for c in RUN]).agg(F.max("accuracy").alias("_top"))
    same = F.lit(True)
    for c in RUN:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    bound = F.greatest(F.lit(C.ACCURACY_AXIS_FLOOR), F.coalesce(F.col("_top"), F.lit(C.ACCURACY_AXIS_FLOOR)))
    return generations.join(top, same).select(*RUN, "gen", "accuracy", bound.alias("y_max"))


def best_so_far(generations: DataFrame | Segments) -> DataFrame:
    """Running best accuracy along a run."""
    cut = segments(generations, RUN, ["gen"]).derive(lambda g: g.select(*RUN, "gen", "accuracy", "_pid", "_loc"))
    return cut.scan(best={"best_so_far": "accuracy"})


def latest_generation(generations: DataFrame | Segments) -> DataFrame:
    """T-5: the latest generation of each run (the default selection).  Of several
    with the run's last index (T27), the first by its other columns."""
    rows = plain(generations)
    last = rows.groupBy(*RUN).agg(F.max("gen").alias("gen"))
    rest = [c for c in rows.columns if c not in (*RUN, "gen")]
    ties = Window.partitionBy(*RUN, "gen").orderBy(*(rest or ["gen"]))
    return rows.join(last, [*RUN, "gen"], "left_semi").withColumn("_rn", F.row_number().over(ties)) \
        .where(F.col("_rn") == 1).drop("_rn")


def _paired(metrics: DataFrame | Segments, run: list[str] | None = None) -> DataFrame:
    """Each metric row in two roles -- "current" at its generation and
    "previous" at the run's next generation -- grouped per (run, gen, key).

    The next generation (the smallest gen above this one) and the run's first come from one
    segmented scan; the first generation of a run takes no role as current.  The grouping
    spreads a run over its generations; no self-join.
    """
    RUN_ = run or RUN
    value = metric_value(metrics.rows if isinstance(metrics, Segments) else metrics)
    cut = segments(metrics, RUN_, ["gen"]).derive(lambda m: m.select(*RUN_, "gen", "key", value.alias("value"), "_pid", "_loc"))
    v = cut.scan(following={"next_gen": "gen"}, first={"first_gen": "gen"})
    roles = F.array(
        F.struct(F.col("gen").alias("at"), F.lit(True).alias("cur"), F.col("value").alias("v"),
                 F.lit(None).cast(v.schema["gen"].dataType).alias("pg")),
        F.struct(F.col("next_gen").alias("at"), F.lit(False).alias("cur"), F.col("value").alias("v"),
                 F.col("gen").alias("pg")),
    )
    r = v.select(*RUN_, "key", "first_gen", F.explode(roles).alias("r")).where(
        F.col("r.at").isNotNull() & (F.col("r.at") != F.col("first_gen")))
    return r.groupBy(*RUN_, F.col("r.at").alias("gen"), "key").agg(
        F.max(F.when(F.col("r.cur"), F.col("r.v"))).alias("curr_value"),
        F.max(F.when(~F.col("r.cur"), F.col("r.v"))).alias("prev_value"),
        F.bool_or(F.col("r.cur")).alias("in_curr"),
        F.bool_or(~F.col("r.cur")).alias("in_prev"),
        F.max(F.col("r.pg")).alias("prev_gen"),
    )


def metric_deltas(metrics: DataFrame | Segments, run: list[str] | None = None) -> DataFrame:
    """Per key present in a generation *and* the immediately previous one,
    ``current - previous`` when both are numeric."""
    p = _paired(metrics, run)
    return p.where(F.col("in_curr") & F.col("in_prev") & F.col("curr_value").isNotNull()
                   & F.col("prev_value").isNotNull()).select(
        *(run or RUN), "gen", "prev_gen", "key", "prev_value", F.col("curr_value").alias("value"),
        _r(F.col("curr_value") - F.col("prev_value")).alias("delta"))


def metric_comparison(metrics: DataFrame | Segments, run: list[str] | None = None) -> DataFrame:
    """W2 + U1: every key of a generation or its predecessor; values missing on
    one side are NULL with a presence flag; delta only when both are numeric."""
    p = _paired(metrics, run)
    return p.select(*(run or RUN), "gen", "key", "prev_value", "curr_value", "in_prev", "in_curr",
                    _r(F.col("curr_value") - F.col("prev_value")).alias("delta"))


def code_growth(versions: DataFrame | Segments, run: list[str] | None = None) -> DataFrame:
    """W3 (+P15 on the input): bytes percent change and line delta to the
    previous generation; a zero previous size gives NULL, not an error."""
    run = run or RUN
    cut = segments(versions, run, ["gen"]).derive(lambda v: v.select(*run, "gen", "size", "lines", "_pid", "_loc"))
    prev_size, prev_lines = F.col("_prev_size"), F.col("_prev_lines")
    return cut.scan(previous={"_prev_size": "size", "_prev_lines": "lines"}).select(
        *run, "gen", "size", "lines",
        _r(F.try_divide((F.col("size") - prev_size) * 100.0, prev_size.cast("double"))).alias("size_pct"),
        (F.col("lines") - prev_lines).alias("lines_delta"),
    )


def resolve_metrics(*sources: DataFrame) -> DataFrame:
    """Metric rows by source priority.  ``sources`` are long tables in
    priority order; a generation takes all rows of its best non-empty source."""
    tagged = None
    for prio, s in enumerate(sources, start=1):
        t = s.select(*RUN, "gen", "key", "num", "str", F.lit(prio).alias("prio"))
        tagged = t if tagged is None else tagged.unionByName(t)
    w = Window.partitionBy(*RUN, "gen")
    return tagged.withColumn("_best", F.min("prio").over(w)).where(F.col("prio") == F.col("_best")).drop("_best")


def leaderboard(summary: DataFrame, metric: str = "accuracy", partition: list[str] | None = None) -> DataFrame:
    """T-6: every generation of every run with its score and rank within the run
    (best first, earliest generation on ties)."""
    order = [F.col(metric).desc_nulls_last(), F.col("gen").asc()]
    names = [F.col(c).asc() for c in summary.columns if c in ("run_name", "gen_name")]  # T27: indexes may be shared
    return ordinal(summary, partition or RUN, order + names, "rank_in_run")
