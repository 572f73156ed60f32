"""Registered history queries: runs, finals, series, deltas, metrics, insights, code growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.logs import insight_preview, insights, log_metrics_struct
from ..functions.logs import java_pattern
from ..functions.text import line_count
from ..operators import history as H
from . import bindings as B
from . import oracle as O
from .catalog import register

GENS_SQL = """
gens AS (SELECT user_id AS run_id,
                CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS gen,
                event_id, ts, event_type, value AS accuracy, event_type <> 'error' AS success
         FROM events)"""

METRICS_SQL = GENS_SQL + """,
metrics AS (SELECT run_id, gen, 'accuracy' AS key, accuracy AS num FROM gens
            UNION ALL SELECT run_id, gen, event_type AS key, accuracy AS num FROM gens),
ranks AS (SELECT run_id, gen, row_number() OVER (PARTITION BY run_id ORDER BY gen) AS rank
          FROM (SELECT DISTINCT run_id, gen FROM metrics)),
mv AS (SELECT m.*, r.rank FROM metrics m JOIN ranks r ON m.run_id = r.run_id AND m.gen = r.gen)"""


@register("run_summary", f"""
WITH {GENS_SQL}
SELECT run_id, CAST(count(*) AS BIGINT) AS num_generations, max(accuracy) AS best_accuracy
FROM gens GROUP BY run_id
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.run_summary(B.b_generations(spark, sf_dir))


@register("run_finals", f"""
WITH {GENS_SQL},
best AS (SELECT run_id, gen AS best_gen FROM (
           SELECT run_id, gen, row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, gen ASC) AS rn
           FROM gens WHERE accuracy IS NOT NULL) WHERE rn = 1),
ends AS (SELECT DISTINCT run_id,
                first_value(accuracy) OVER (PARTITION BY run_id ORDER BY gen) AS first_accuracy,
                first_value(accuracy) OVER (PARTITION BY run_id ORDER BY gen DESC) AS last_accuracy
         FROM gens),
agg AS (SELECT run_id, CAST(count(*) AS BIGINT) AS total_generations,
               CAST(count(*) FILTER (WHERE coalesce(success, true)) AS BIGINT) AS successful_generations,
               min(gen) AS first_gen, max(gen) AS last_gen, max(accuracy) AS best_accuracy
        FROM gens GROUP BY run_id)
SELECT agg.*, best.best_gen, ends.first_accuracy, ends.last_accuracy,
       round(ends.last_accuracy - ends.first_accuracy, 6) AS accuracy_gain
FROM agg LEFT JOIN best ON agg.run_id = best.run_id JOIN ends ON agg.run_id = ends.run_id
""")
def run_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.run_finals(B.b_generations(spark, sf_dir))


@register("accuracy_series", f"""
WITH {GENS_SQL}
SELECT run_id, gen, accuracy,
       greatest(50.0, coalesce(max(accuracy) OVER (PARTITION BY run_id), 50.0)) AS y_max
FROM gens
""")
def accuracy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.accuracy_series(B.b_generations(spark, sf_dir))


@register("best_so_far", f"""
WITH {GENS_SQL}
SELECT run_id, gen, accuracy,
       max(accuracy) OVER (PARTITION BY run_id ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS best_so_far
FROM gens
""")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.best_so_far(B.b_history(spark, sf_dir))


@register("latest_generation", f"""
WITH {GENS_SQL}
SELECT run_id, gen, event_id, ts, event_type, accuracy, success FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gen DESC) AS rn FROM gens) WHERE rn = 1
""")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_generation(B.b_generations(spark, sf_dir))


@register("metric_deltas", f"""
WITH {METRICS_SQL}
SELECT c.run_id, c.gen, p.gen AS prev_gen, c.key, p.num AS prev_value, c.num AS value,
       round(c.num - p.num, 6) AS delta
FROM mv c JOIN mv p ON c.run_id = p.run_id AND c.rank = p.rank + 1 AND c.key = p.key
WHERE c.num IS NOT NULL AND p.num IS NOT NULL
""")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.metric_deltas(B.b_metric_history(spark, sf_dir))


@register("metric_comparison", f"""
WITH {METRICS_SQL},
cur AS (SELECT run_id, rank, key, num AS curr_value FROM mv),
prv AS (SELECT run_id, rank + 1 AS rank, key, num AS prev_value FROM mv),
fo AS (SELECT coalesce(cur.run_id, prv.run_id) AS run_id, coalesce(cur.rank, prv.rank) AS rank,
              coalesce(cur.key, prv.key) AS key, prv.prev_value, cur.curr_value,
              prv.rank IS NOT NULL AS in_prev, cur.rank IS NOT NULL AS in_curr
       FROM cur FULL OUTER JOIN prv ON cur.run_id = prv.run_id AND cur.rank = prv.rank AND cur.key = prv.key)
SELECT fo.run_id, r.gen, fo.key, fo.prev_value, fo.curr_value, fo.in_prev, fo.in_curr,
       round(fo.curr_value - fo.prev_value, 6) AS delta
FROM fo JOIN ranks r ON fo.run_id = r.run_id AND fo.rank = r.rank WHERE r.rank > 1
""")
def metric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.metric_comparison(B.b_metric_history(spark, sf_dir))


def _cents_text(col: str) -> str:
    cents = f"CAST(round({col} * 100) AS BIGINT)"
    return f"(CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def _log_sql() -> str:
    v = _cents_text("accuracy")
    k = "CAST(event_id % 100 AS VARCHAR)"
    return f"""
logs AS (SELECT run_id, gen, event_type, accuracy,
                CASE event_type WHEN 'view' THEN 'Epoch done' || chr(10) || 'Accuracy: ' || {v} || '%'
                                WHEN 'click' THEN 'val=' || {v} || chr(10) || 'saved'
                                WHEN 'purchase' THEN {k} || '/100 correct' || chr(10) || {k} || '/100 questions'
                                WHEN 'signup' THEN 'validation: ' || {v} || chr(10) || 'test accuracy = ' || {v}
                                ELSE 'ERROR ' || {v} END AS log
         FROM gens)"""


def _metric_sql(metric: str) -> str:
    parts = [f"nullif(regexp_extract(log, {O.q('(?i)' + java_pattern(p))}, 1), '')"
             for p in C.LOG_METRIC_PATTERNS[metric]]
    return f"CAST(coalesce({', '.join(parts)}) AS DOUBLE)"


LOG_LONG_SQL = f"""
{GENS_SQL},
{_log_sql()},
lm AS (SELECT run_id, gen, {_metric_sql('accuracy')} AS accuracy, {_metric_sql('validation')} AS validation,
              {_metric_sql('correct')} AS correct, {_metric_sql('total')} AS total FROM logs),
log_long AS (
  SELECT run_id, gen, 'accuracy' AS key, accuracy AS value FROM lm WHERE accuracy IS NOT NULL
  UNION ALL SELECT run_id, gen, 'validation', validation FROM lm WHERE validation IS NOT NULL
  UNION ALL SELECT run_id, gen, 'correct', correct FROM lm WHERE correct IS NOT NULL
  UNION ALL SELECT run_id, gen, 'total', total FROM lm WHERE total IS NOT NULL)"""


def _log_long(spark: SparkSession, sf_dir: str, gens: DataFrame | None = None) -> DataFrame:
    logs = B.b_log_lines(spark, sf_dir, gens)
    m = logs.select("run_id", "gen", log_metrics_struct(F.col("log")).alias("m"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col("m")[k].alias("value")) for k in C.LOG_METRIC_PATTERNS))
    return m.select("run_id", "gen", F.inline(pairs)).where(F.col("value").isNotNull())


@register("log_metrics", f"""
WITH {LOG_LONG_SQL}
SELECT run_id, gen, key, value FROM log_long
""")
def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_long(spark, sf_dir)


@register("resolve_metrics", f"""
WITH {LOG_LONG_SQL},
src AS (
  SELECT run_id, gen, 'accuracy' AS key, accuracy AS num, CAST(NULL AS VARCHAR) AS str, 1 AS prio
    FROM gens WHERE event_type IN ('click', 'purchase')
  UNION ALL SELECT run_id, gen, event_type, accuracy, CAST(NULL AS VARCHAR), 1
    FROM gens WHERE event_type IN ('click', 'purchase')
  UNION ALL SELECT run_id, gen, 'accuracy', accuracy, CAST(NULL AS VARCHAR), 2
    FROM gens WHERE event_type IN ('click', 'signup', 'view')
  UNION ALL SELECT run_id, gen, key, value, CAST(NULL AS VARCHAR), 3 FROM log_long)
SELECT run_id, gen, key, num, str, prio FROM (
  SELECT *, min(prio) OVER (PARTITION BY run_id, gen) AS best FROM src) WHERE prio = best
""")
def resolve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = B.b_generations(spark, sf_dir)
    m = B.b_metrics(spark, sf_dir, gens)
    g = gens.select("run_id", "gen", "event_type")
    nostr = F.lit(None).cast("string").alias("str")
    results = m.join(g.where(F.col("event_type").isin("click", "purchase")), ["run_id", "gen"], "left_semi") \
        .select("run_id", "gen", "key", "num", nostr)
    detailed = m.where(F.col("key") == "accuracy").join(
        g.where(F.col("event_type").isin("click", "signup", "view")), ["run_id", "gen"], "left_semi"
    ).select("run_id", "gen", "key", "num", nostr)
    logs = _log_long(spark, sf_dir, gens).select("run_id", "gen", "key", F.col("value").alias("num"), nostr)
    return H.resolve_metrics(results, detailed, logs)


@register("insights", f"""
WITH n AS (SELECT doc_id, '- ' || replace(text, chr(10), chr(10) || '- ') AS note FROM documents),
x AS (SELECT doc_id, list_slice(list_filter(list_transform(list_concat(
          regexp_extract_all(note, {O.q('(?m)' + java_pattern(C.BULLET_PATTERN))}, 1),
          regexp_extract_all(note, {O.q('(?m)' + java_pattern(C.NUMBERED_PATTERN))}, 1)),
          lambda s: {O.strip('s')}), lambda s: length(s) > 20 AND NOT ends_with(s, ':')), 1, 5) AS ins
      FROM n),
y AS (SELECT doc_id, CAST(generate_subscripts(ins, 1) AS INTEGER) AS pos, unnest(ins) AS insight FROM x)
SELECT doc_id, pos, insight,
       CASE WHEN length(insight) > 200 THEN left(insight, 200) || '...' ELSE insight END AS preview
FROM y
""")
def insights_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = B.b_notes(spark, sf_dir)
    ex = notes.select("doc_id", F.posexplode(insights(F.col("note"))).alias("p", "insight"))
    return ex.select("doc_id", (F.col("p") + 1).cast("int").alias("pos"), "insight",
                     insight_preview(F.col("insight")).alias("preview"))


@register("code_growth", """
WITH v AS (SELECT CAST(doc_id // 10 AS BIGINT) AS run_id, CAST(doc_id % 10 + 1 AS BIGINT) AS gen,
                  CAST(strlen(text) AS BIGINT) AS size,
                  CAST(len(string_split_regex(text, '\\r\\n|\\r|\\n')) - 1
                       + CASE WHEN length(text) > 0 AND NOT regexp_matches(text, '[\\r\\n]\\z') THEN 1 ELSE 0 END
                       AS INTEGER) AS lines
           FROM documents),
w AS (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY gen) AS ps,
                lag(lines) OVER (PARTITION BY run_id ORDER BY gen) AS pl FROM v)
SELECT run_id, gen, size, lines,
       round(CAST(size - ps AS DOUBLE) * 100.0 / nullif(CAST(ps AS DOUBLE), 0), 6) AS size_pct,
       lines - pl AS lines_delta
FROM w
""")
def code_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.b_code_versions(spark, sf_dir)
    stats = v.select("run_id", "gen", F.octet_length("text").cast("bigint").alias("size"),
                     line_count(F.col("text")).alias("lines"))
    return H.code_growth(stats)
