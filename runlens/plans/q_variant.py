"""Registered queries over VARIANT documents and file tables built from the test tables:
messages and their blocks, tool calls, submissions, results, nested profiles, artefacts.

The bindings write JSON text and parse it (``strict_json``), as the tree readers do; the SQL
twins state the expected rows from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.flatten import flatten_rows
from ..functions.json import accuracy_percent, scalar_metrics, strict_json
from ..functions.text import parse_percent
from ..operators import history as H
from ..operators import trajectories as J
from ..sources import tree as S
from ..sources.artifacts import explode_submission, normalize_turn
from . import bindings as B
from .catalog import register
from .oracle import q, strip


def _json(**fields) -> Column:
    """The JSON text of an object, null fields kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _one(block: Column) -> Column:
    return F.concat(F.lit("["), block, F.lit("]"))


# --------------------------------------------------------------------------- #
# A turn of every shape of content
# --------------------------------------------------------------------------- #
def b_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as message objects, the content's shape by (conv_id + turn) % 6;
    the first turn has no role."""
    c = B.table(spark, sf_dir, "conversations")
    text = F.col("text")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    quoted = F.to_json(F.array(text))                       # ["..."]
    content = (
        F.when(kind == 0, F.substring(quoted, F.lit(2), F.length(quoted) - 2))
        .when(kind == 1, F.concat(F.lit("["), _json(type=F.lit("text"), text=text), F.lit(', "plain"]')))
        .when(kind == 2, _one(_json(type=F.lit("tool_use"), name=F.lit("run"), input=F.struct(F.col("turn").alias("n")))))
        .when(kind == 3, _one(_json(type=F.lit("tool_result"), content=text)))
        .when(kind == 4, F.lit("null"))
        .otherwise(F.col("turn").cast("string")))
    role = F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit('"role": "'), F.col("role"), F.lit('", ')))
    doc = F.concat(F.lit("{"), role, F.lit('"content": '), content, F.lit("}"))
    return c.where("text IS NOT NULL").select("conv_id", "turn", strict_json(doc).alias("msg"))


@register("normalize_turns", f"""
SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'unknown' ELSE role END AS role,
       CASE (conv_id + turn) % 6
            WHEN 0 THEN text
            WHEN 1 THEN {strip("text || chr(10) || chr(10) || 'plain'")}
            WHEN 2 THEN '[tool_use: run]' || chr(10) || '{{"n":' || turn || '}}'
            WHEN 3 THEN {strip("'[tool_result]' || chr(10) || text")}
            WHEN 4 THEN ''
            ELSE CAST(turn AS VARCHAR) END AS text
FROM conversations WHERE text IS NOT NULL
""")
def normalize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b_messages(spark, sf_dir).select("conv_id", "turn", normalize_turn(F.col("msg")).alias("t")).select("conv_id", "turn", "t.*")


# --------------------------------------------------------------------------- #
# Tool calls with their results
# --------------------------------------------------------------------------- #
def b_tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as two calls each, every other turn as the result of the turn before."""
    c = B.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    call = lambda n: F.struct(
        F.concat_ws("-", F.lit("c"), F.col("turn").cast("string"), F.lit(str(n))).alias("id"),
        F.struct(F.lit(f"tool{n}").alias("name"), F.col("text").alias("arguments")).alias("function"))
    calls = _json(role=F.lit("assistant"), tool_calls=F.array(call(0), call(1)))
    result = _json(role=F.lit("tool"), tool_call_id=F.concat_ws("-", F.lit("c"), (F.col("turn") - 1).cast("string"), F.lit("0")), content=F.col("text"))
    doc = strict_json(F.when(F.col("role") == "assistant", calls).otherwise(result))
    return J.tool_messages(c.select((F.col("conv_id") % 4).alias("run_id"), F.lit(1).cast("bigint").alias("gen"),
                                    F.col("conv_id").alias("question_id"), "turn", doc.alias("msg")), "msg")


@register("tool_calls", """
WITH c AS (SELECT conv_id % 4 AS run_id, CAST(1 AS BIGINT) AS gen, conv_id AS question_id, turn AS call_turn, 'c-' || turn || '-' || n AS call_id,
                  'tool' || n AS tool, text AS arguments
           FROM conversations, (SELECT unnest([0, 1]) AS n) WHERE role = 'assistant' AND text IS NOT NULL),
r AS (SELECT conv_id AS question_id, 'c-' || (turn - 1) || '-0' AS call_id, turn AS result_turn, text AS result FROM conversations
      WHERE role <> 'assistant' AND text IS NOT NULL)
SELECT c.*, r.result_turn, r.result FROM c LEFT JOIN r ON c.question_id = r.question_id AND c.call_id = r.call_id
""")
def tool_calls_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.tool_calls(b_tool_messages(spark, sf_dir), ["run_id", "gen", "question_id"])
    return found.select("run_id", "gen", "question_id", "call_turn", "call_id", "tool", "arguments", "result_turn", "result")


# --------------------------------------------------------------------------- #
# Submissions of three shapes
# --------------------------------------------------------------------------- #
@register("submission_answers", """
SELECT lang AS task, doc_id AS run_id, CAST(1 AS BIGINT) AS gen, doc_id AS question_id, substr(text, 1, 6) AS answer
FROM documents WHERE text IS NOT NULL
UNION ALL SELECT lang, doc_id, 1, doc_id + 1, '7' FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0
UNION ALL SELECT lang, doc_id, 1, doc_id + 2, '' FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0
""")
def submission_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per document: a detail list (with a string id and a null id, which match no
    question), an answers object (with a key that is no number), or plain keys beside reserved ones."""
    d = B.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.substring("text", 1, 6).alias("a"))
    i = F.col("doc_id").cast("string")
    a = F.substring(F.to_json(F.array("a")), F.lit(2), F.length(F.to_json(F.array("a"))) - 2)
    item = lambda key, value: F.concat(F.lit('{"question_id": '), key, F.lit(', "model_answer": '), value, F.lit("}"))
    details = F.concat(F.lit('{"details": ['), F.concat_ws(", ", item(i, a), item(F.concat(F.lit('"'), i, F.lit('"')), a), item(F.lit("null"), a),
                       item((F.col("doc_id") + 1).cast("string"), F.lit("7")), F.concat(F.lit('{"question_id": '), (F.col("doc_id") + 2).cast("string"), F.lit("}"))), F.lit("]}"))
    answers = F.concat(F.lit('{"answers": {"'), i, F.lit('": '), a, F.lit(', "x": "A"}, "model": "m"}'))
    plain = F.concat(F.lit('{"model": "5", "total_questions": 3, "'), i, F.lit('": '), a, F.lit("}"))
    doc = F.when(F.col("doc_id") % 3 == 0, details).when(F.col("doc_id") % 3 == 1, answers).otherwise(plain)
    subs = d.select(F.col("lang").alias("task"), F.col("doc_id").alias("run_id"), F.lit(1).cast("bigint").alias("gen"), strict_json(doc).alias("doc"))
    return explode_submission(subs).drop("pos")


# --------------------------------------------------------------------------- #
# Results, outcomes, profiles
# --------------------------------------------------------------------------- #
def b_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results document per document: an accuracy as percent, fraction or flag, and other fields."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    n = F.col("n_chars").cast("string")
    acc = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('"accuracy_percent": '), n, F.lit(".5, ")))
           .when(F.col("doc_id") % 4 == 1, F.lit('"accuracy": 0.25, '))
           .when(F.col("doc_id") % 4 == 2, F.lit('"accuracy": true, ')).otherwise(F.lit('"accuracy": "high", ')))
    doc = F.concat(F.lit("{"), acc, F.lit('"n": '), n, F.lit(', "source": "'), F.col("source"), F.lit('", "list": [1], "inner": {"a": 1}, "none": null}'))
    return d.select("doc_id", strict_json(doc).alias("doc"))


@register("accuracy_percents", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars + 0.5::DOUBLE WHEN 1 THEN 25.0::DOUBLE WHEN 2 THEN 100.0::DOUBLE END AS accuracy_percent FROM documents
""")
def accuracy_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b_results(spark, sf_dir).select("doc_id", accuracy_percent(F.col("doc")).alias("accuracy_percent"))


@register("scalar_metrics", """
SELECT doc_id, 'n' AS key, 'int' AS kind, CAST(n_chars AS DOUBLE) AS num, CAST(n_chars AS VARCHAR) AS str FROM documents
UNION ALL SELECT doc_id, 'source', 'string', NULL, source FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, 'accuracy_percent', 'float', n_chars + 0.5, n_chars || '.5' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'accuracy', 'float', 0.25, '0.25' FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'accuracy', 'bool', 1.0, 'True' FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 'accuracy', 'string', NULL, 'high' FROM documents WHERE doc_id % 4 = 3
""")
def scalar_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_metrics(b_results(spark, sf_dir), "doc", ["doc_id"])


@register("parse_percent", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS DOUBLE) WHEN 1 THEN n_chars + 0.25::DOUBLE WHEN 2 THEN CAST(doc_id AS DOUBLE) END AS value FROM documents
""")
def parse_percent_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    text = (F.when(F.col("doc_id") % 4 == 0, F.concat(n, F.lit("%"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" "), n, F.lit(".25 ")))
            .when(F.col("doc_id") % 4 == 2, F.concat(F.col("doc_id").cast("string"), F.lit("%%"))).otherwise(F.concat(n, F.lit(" of 10"))))
    return B.table(spark, sf_dir, "documents").select("doc_id", parse_percent(text).alias("value"))


@register("trajectory_outcomes", """
SELECT doc_id // 10 AS run_id, CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (WHERE doc_id % 8 = 0) AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE doc_id % 8 IN (1, 2, 3)) AS BIGINT) AS failed
FROM documents GROUP BY 1
""")
def trajectory_outcomes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution documents: a list, truthy errors ("0" and "false" among them), falsy ones, other kinds."""
    docs = F.array(*[F.lit(x) for x in ('[{"role": "user"}]', '{"error": "x"}', '{"error": "0"}', '{"error": ["false"]}',
                                        '{"error": ""}', '{"error": {}}', '{"error": 0}', '"error"')])
    d = B.table(spark, sf_dir, "documents").select("doc_id")
    runs = d.select(F.expr("doc_id div 10").alias("run_id"), strict_json(F.element_at(docs, (F.col("doc_id") % 8 + 1).cast("int"))).alias("doc"))
    return J.trajectory_outcomes(runs, ["run_id"])


DEPTH = 12


@register("flatten_profiles", f"""
SELECT doc_id, 'doc.id' AS key, CAST(doc_id AS VARCHAR) AS value FROM documents
UNION ALL SELECT doc_id, 'doc.meta.lang', lang FROM documents WHERE lang <> ''
UNION ALL SELECT doc_id, 'doc.meta.size', n_chars || '.25' FROM documents
UNION ALL SELECT doc_id, 'doc.meta.text', text FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, 'tags', source || ', 1, a,b' FROM documents
UNION ALL SELECT doc_id, {q('.'.join(f'k{i}' for i in range(DEPTH)))}, 'true' FROM documents
""")
def flatten_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile per document: whole text, a list, empty fields, and objects twelve levels deep."""
    d = B.table(spark, sf_dir, "documents").where("n_chars IS NOT NULL AND source IS NOT NULL")
    meta = F.struct("lang", "text", F.lit("").alias("empty"), F.lit(None).cast("string").alias("none"),
                    (F.col("n_chars") + F.lit(0.25)).cast("decimal(20,2)").alias("size"))
    head = _json(doc=F.struct(F.col("doc_id").alias("id"), meta.alias("meta")))
    deep = "".join(f'{{"k{i}": ' for i in range(DEPTH)) + "true" + "}" * DEPTH
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "tags": ["'), F.col("source"), F.lit('", 1, ["a", "b"]], '), F.lit(deep[1:]))
    return flatten_rows(d.select("doc_id", strict_json(text).alias("doc")), "doc", ["doc_id"])


# --------------------------------------------------------------------------- #
# File tables: S4, S5, S7, A7, P20, J8, T-1
# --------------------------------------------------------------------------- #
NAMES = ("target_agent.py", "results.json", "evaluation_results.json", "agent_execution/execution_q{d}.json", "improvement.md",
         "results/part_{d}.json", "submission_{d}.json", "openhands_trajectory/s/events/{d}.json", "train_stdout.log", "notes_{d}.json")


def b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a runs tree: run by source, generation by doc_id // 23, name by doc_id % 10."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    did = F.col("doc_id").cast("string")
    rel = F.element_at(F.array(*[F.replace(F.lit(n), F.lit("{d}"), did) for n in NAMES]), (F.col("doc_id") % 10 + 1).cast("int"))
    run_id = F.expr("crc32(source) % 100000").cast("int")
    gen = F.expr("doc_id div 23").cast("int")
    return d.select(
        F.concat(F.lit("run_"), run_id.cast("string")).alias("run_name"), run_id.alias("run_id"),
        F.concat(F.lit("gen_"), gen.cast("string")).alias("gen_name"), gen.alias("gen"), rel.alias("rel_path"),
        F.element_at(F.split(rel, "/"), -1).alias("name"), F.concat(F.lit("/r/"), did).alias("path"),
        F.timestamp_seconds(F.col("n_chars") % 50).alias("mtime"), F.col("n_chars").alias("length"))


_FILES = "files AS (SELECT 'g' || source AS run_key, source, doc_id // 23 AS gen, doc_id, doc_id % 10 AS k, n_chars % 50 AS mtime FROM documents)"


def _by_source(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's source in place of its keys."""
    names = B.table(spark, sf_dir, "documents").select("source").distinct().select(
        "source", F.concat(F.lit("run_"), F.expr("crc32(source) % 100000").cast("string")).alias("run_name"))
    return df.join(names, "run_name").drop("run_name", "run_id", "gen_name").withColumn("gen", F.col("gen").cast("bigint"))


@register("artifact_matrix", f"""
WITH {_FILES}
SELECT source, gen, bool_or(k = 0) AS has_target_agent, bool_or(k = 4) AS has_improvement, false AS has_meta_prompt, false AS has_feedback_prompt,
       bool_or(k = 8) AS has_stdout_log, bool_or(k = 7) AS has_openhands,
       CASE WHEN bool_or(k = 3) THEN 'Multi-trajectory' ELSE 'Single' END AS execution_type
FROM files GROUP BY source, gen
""")
def artifact_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b_files(spark, sf_dir)
    return _by_source(S.artifact_matrix(files).join(S.execution_type(files), S.GEN), spark, sf_dir)


@register("pick_results", f"""
WITH {_FILES},
p AS (SELECT source, gen, max(k) AS k FROM files WHERE k IN (1, 2) GROUP BY source, gen)
SELECT source, gen, CASE k WHEN 2 THEN 'evaluation_results.json' ELSE 'results.json' END AS rel_path FROM p
""")
def pick_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(S.pick_by_priority(b_files(spark, sf_dir), C.EVAL_RESULT_NAMES).select(*S.GEN, "rel_path"), spark, sf_dir)


@register("discover_submission", f"""
WITH {_FILES},
t AS (SELECT *, CASE k WHEN 5 THEN 0 WHEN 1 THEN 2 WHEN 6 THEN 3 WHEN 2 THEN 9 WHEN 9 THEN 9 END AS tier FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY source, gen ORDER BY tier, mtime DESC, '/r/' || doc_id) AS n FROM t WHERE tier IS NOT NULL)
SELECT source, gen, '/r/' || doc_id AS path, CAST(tier AS INTEGER) AS tier FROM r WHERE n = 1
""")
def discover_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.discover_submission(b_files(spark, sf_dir)).select(*S.GEN, "path", F.col("tier").cast("int").alias("tier"))
    return _by_source(found, spark, sf_dir)


@register("trajectory_ids", f"""
WITH {_FILES}
SELECT source, gen, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS trajectories FROM files WHERE k = 3 GROUP BY source, gen
""")
def trajectory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = S.trajectory_ids(b_files(spark, sf_dir))
    return _by_source(ids.withColumn("trajectories", F.array_join(F.col("trajectories").cast("array<string>"), ",")), spark, sf_dir)


@register("run_detail", f"""
WITH {_FILES},
g AS (SELECT source, gen, count(*) AS n, count(*) FILTER (WHERE k = 3) AS t FROM files GROUP BY source, gen)
SELECT source, CAST(count(*) AS BIGINT) AS num_generations, max(gen) AS last_gen,
       string_agg(gen || ':' || n || ':' || t, ' ' ORDER BY gen) AS generations
FROM g GROUP BY source
""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + T-1: generations with their files and trajectories nested in their run, newest run first."""
    files = b_files(spark, sf_dir)
    g = files.groupBy(*S.GEN).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rel_path").startswith(C.AGENT_EXECUTION_DIR + "/")).alias("t"))
    nested = g.groupBy(*S.RUN).agg(
        F.count(F.lit(1)).alias("num_generations"), F.max("gen").alias("gen"),
        F.array_sort(F.collect_list(F.struct("gen", "n", "t"))).alias("generations"))
    shown = F.array_join(F.transform("generations", lambda x: F.concat_ws(":", x["gen"], x["n"], x["t"])), " ")
    runs = _by_source(H.runs_newest_first(nested).withColumn("gen_name", F.lit(None)).withColumn("generations", shown), spark, sf_dir)
    return runs.withColumnRenamed("gen", "last_gen")
