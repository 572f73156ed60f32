"""Segmented scans against plain windows, on any cut and on a hot run."""

import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import history as H
from runlens.operators.segments import LOC, PID, Segments

LOCAL_COLUMNS = ["g", "o", "v", "n", "prev", "best", "next_o", "first_o"]


def _windowed(df):
    w = Window.partitionBy("g").orderBy("o")
    all_of = Window.partitionBy("g")
    return df.select(
        "g", "o", "v", F.row_number().over(w).cast("bigint").alias("n"), F.lag("v").over(w).alias("prev"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("best"),
        F.min("o").over(w.rangeBetween(1, Window.unboundedFollowing)).alias("next_o"), F.min("o").over(all_of).alias("first_o"))


def _rows(df):
    return sorted(map(tuple, df.select(*LOCAL_COLUMNS).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_scan_equals_windows(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for g, n in [(None, 25), ("a", 1), ("b", 120), ("c", 2), ("d", 60), ("e", 7)]:
        order = rng.sample(range(1000), n)
        rows += [(g, o, rng.choice([None, float(rng.randrange(50)), -1.5])) for o in order]
    df = spark.createDataFrame(rows, "g string, o long, v double").repartition(5)
    got = Segments.of(df, ["g"], ["o"], partitions).scan(
        number="n", previous={"prev": "v"}, best={"best": "v"}, following={"next_o": "o"}, first={"first_o": "o"})
    assert _rows(got) == _rows(_windowed(df))


def test_numbered_rows_keep_their_segments(spark):
    df = spark.createDataFrame([(i % 3, i, float(-i)) for i in range(90)], "g int, o int, v double")
    cut = Segments.of(df, ["g"], ["o"], 7).numbered("k").derive(lambda d: d.where("k % 2 = 1"))
    got = cut.scan(previous={"p": "k"}, following={"f": "k"}, best={"b": "v"}).collect()
    assert len(got) == 45
    for r in got:
        assert r.p == (r.k - 2 if r.k > 1 else None) and r.f == (r.k + 2 if r.k < 29 else None)
        assert r.b == max(x.v for x in got if x.g == r.g and x.k <= r.k)


def test_empty_table(spark):
    df = spark.createDataFrame([], "g int, o int, v double")
    assert Segments.of(df, ["g"], ["o"], 4).scan(number="n", best={"b": "v"}).collect() == []


def _hot(spark, n=24_000):
    """A third of all generations belongs to run 0."""
    run = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 400 + 1)
    df = spark.range(n).select(run.cast("long").alias("run_id"), (F.col("id") + 1).alias("gen"),
                               (F.xxhash64("id") % 1000 / 10.0).alias("accuracy"))
    return df


def test_a_hot_run_is_spread_over_tasks(spark):
    """No task scans more than twice the median, and none holds the run."""
    gens = _hot(spark)
    cut = Segments.of(gens, ["run_id"], ["gen"], 12)
    assert cut.rows.where("run_id = 0").select(PID).distinct().count() >= 4
    placed = cut.rows.repartitionById(12, PID).select(F.spark_partition_id().alias("p"), PID, LOC)
    assert placed.where(f"p <> {PID}").count() == 0
    sizes = [r["count"] for r in placed.groupBy("p").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * median(sizes)


@pytest.mark.parametrize("operator", ["best_so_far", "metric_deltas", "accuracy_series", "run_finals", "code_growth",
                                      "latest_generation", "leaderboard", "metric_comparison"])
def test_history_of_a_hot_run(spark, operator):
    """The operators on the hot run against plain windows (SQL)."""
    gens = _hot(spark, 3000).withColumn("accuracy", F.when(F.col("gen") % 7 != 0, F.col("accuracy")))
    gens.createOrReplaceTempView("hot")
    if operator in ("metric_deltas", "metric_comparison"):
        df = getattr(H, operator)(gens.where("gen % 5 <> 0").select("run_id", "gen", F.lit("a").alias("key"), F.col("accuracy").alias("num")))
        base = """SELECT *, lag(accuracy) OVER w AS p, lag(gen) OVER w AS pg FROM hot WHERE gen % 5 <> 0 WINDOW w AS (PARTITION BY run_id ORDER BY gen)"""
        if operator == "metric_deltas":
            want = spark.sql(f"SELECT run_id, gen, pg AS prev_gen, 'a' AS key, p AS prev_value, accuracy AS value, round(accuracy - p, 6) AS delta FROM ({base}) WHERE p IS NOT NULL AND accuracy IS NOT NULL")
        else:
            want = spark.sql(f"SELECT run_id, gen, 'a' AS key, p AS prev_value, accuracy AS curr_value, true AS in_prev, true AS in_curr, round(accuracy - p, 6) AS delta FROM ({base}) WHERE pg IS NOT NULL")
    elif operator == "best_so_far":
        df = H.best_so_far(gens)
        want = spark.sql("SELECT *, max(accuracy) OVER (PARTITION BY run_id ORDER BY gen) AS best_so_far FROM hot")
    elif operator == "accuracy_series":
        df = H.accuracy_series(gens)
        want = spark.sql("SELECT *, greatest(50.0D, max(accuracy) OVER (PARTITION BY run_id)) AS y_max FROM hot")
    elif operator == "latest_generation":
        df = H.latest_generation(gens)
        want = spark.sql("SELECT run_id, gen, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gen DESC) AS r FROM hot) WHERE r = 1")
    elif operator == "leaderboard":
        df = H.leaderboard(gens)
        want = spark.sql("SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC NULLS LAST, gen) AS rank_in_run FROM hot")
    elif operator == "code_growth":
        df = H.code_growth(gens.select("run_id", "gen", F.col("gen").alias("size"), F.lit(1).alias("lines")))
        want = spark.sql("""SELECT run_id, gen, gen AS size, 1 AS lines, round((gen - p) * 100.0D / p, 6) AS size_pct, if(p IS NULL, NULL, 0) AS lines_delta
                            FROM (SELECT *, lag(gen) OVER (PARTITION BY run_id ORDER BY gen) AS p FROM hot)""")
    else:
        df = H.run_finals(gens)
        want = spark.sql("""SELECT run_id, count(*) AS total_generations, count(*) AS successful_generations, min(gen) AS first_gen, max(gen) AS last_gen,
                              min_by(gen, struct(-accuracy, gen)) FILTER (WHERE accuracy IS NOT NULL) AS best_gen, max(accuracy) AS best_accuracy,
                              min_by(accuracy, gen) AS first_accuracy, max_by(accuracy, gen) AS last_accuracy,
                              round(max_by(accuracy, gen) - min_by(accuracy, gen), 6) AS accuracy_gain FROM hot GROUP BY run_id""")
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, want.select(*df.columns).collect()), key=str)
