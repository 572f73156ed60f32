"""Trajectories: turn counts, sample previews, outcome counts, tool-call pairing
(A8, A13, T-3, J9, P20, P13).

``turns`` rows are (run_id, gen, question_id, turn, role, text); the per-turn
text is the normalised form produced by ``sources.artifacts.normalize_turn``.
Counts are hash aggregates; ordered text is only ever assembled for a bounded
number of turns (the ones a preview can show).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.json import json_kind, json_truthy
from .sequence import top_k_per_group


def turn_counts(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Agent turns (assistant messages with content) and messages per trajectory."""
    has_content = (F.col("role") == "assistant") & F.coalesce(F.length("text") > 0, F.lit(False))
    return turns.groupBy(*keys).agg(
        F.count_if(has_content).cast("bigint").alias("agent_turns"),
        F.count(F.lit(1)).cast("bigint").alias("messages"),
    )


def transcript(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One string per trajectory: ``role: text`` lines in turn order.

    Collects the turns it is given: callers bound them first (see
    ``first_trajectories``)."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce(F.col("text"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line"))))
    return turns.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"),
        F.count(F.lit(1)).cast("bigint").alias("messages"),
    )


def first_trajectories(turns: DataFrame, group: list[str], file_key: str,
                       n: int = C.SAMPLE_TRAJECTORIES_N) -> DataFrame:
    """T-3 + P13: the first ``n`` trajectories of each group in *lexicographic*
    file-name order (``execution_q10`` before ``execution_q2``), previewed.

    Bounded at every step: the top ``n`` keys come from a salted two-stage
    top-k, and only the turns that can reach the preview are collected -- a
    line is at least 3 characters (``": "`` plus the separator), so a
    ``TRAJECTORY_PREVIEW_LIMIT``-character preview needs at most ``limit // 3 + 1``
    turns however long the conversation is.
    """
    name = F.concat(F.lit("execution_q"), F.col(file_key).cast("string"), F.lit(".json"))
    keys = turns.select(*group, file_key).distinct().withColumn("file_name", name)
    top = top_k_per_group(keys, group, ["file_name"], n, rank="sample")
    chosen = turns.join(top.select(*group, file_key), group + [file_key], "left_semi")
    counts = chosen.groupBy(*group, file_key).agg(F.count(F.lit(1)).cast("bigint").alias("messages"))
    max_turns = C.TRAJECTORY_PREVIEW_LIMIT // 3 + 1
    head = top_k_per_group(chosen, group + [file_key], ["turn"], max_turns)
    t = transcript(head, group + [file_key]).drop("messages")
    j = t.join(counts, group + [file_key]).join(top, group + [file_key])
    cut = (F.length("transcript") > C.TRAJECTORY_PREVIEW_LIMIT) | (F.col("messages") > max_turns)
    text = F.when(cut, F.concat(F.substring("transcript", 1, C.TRAJECTORY_PREVIEW_LIMIT),
                                F.lit(C.TRAJECTORY_MARKER))).otherwise(F.col("transcript"))
    return j.select(*group, F.col("sample").cast("int").alias("sample"), file_key, "file_name", "messages",
                    text.alias("preview"))


def trajectory_outcomes(executions: DataFrame, keys: list[str]) -> DataFrame:
    """successful = a JSON array; failed = an object with a truthy ``error``.

    On the executions table (S6) a trajectory file that was too large or not
    valid JSON is an error object, so it counts as failed (``{}``, ``[]``, 0, false, null and
    "" are falsy errors, every other string is truthy), and ``count``
    covers every trajectory file, errors included.  Other kinds count in
    neither column.
    """
    kind = json_kind(F.col("doc"))
    failed = (kind == "object") & json_truthy(F.try_variant_get("doc", "$.error", "variant"))
    rows = executions
    if "status" in executions.columns:
        rows = executions.where(F.col("is_multi") & F.col("file").isNotNull())
        failed = F.coalesce(failed, F.lit(False)) | F.col("status").isin("too_large", "bad_json")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.count_if(kind == "array").cast("bigint").alias("successful"),
        F.count_if(failed).cast("bigint").alias("failed"),
    )


def tool_messages(messages: DataFrame, msg: str) -> DataFrame:
    """Message objects (a VARIANT column) as what ``tool_calls`` pairs: their call list, the id of
    the call they answer, and their text."""
    from ..sources.artifacts import normalize_turn

    calls = "array<struct<id: string, function: struct<name: string, arguments: string>>>"
    rest = [c for c in messages.columns if c != msg]
    return messages.select(
        *rest, F.try_variant_get(msg, "$.tool_calls", calls).alias("tool_calls"),
        F.try_variant_get(msg, "$.tool_call_id", "string").alias("tool_call_id"), normalize_turn(F.col(msg))["text"].alias("text"))


def tool_calls(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Pair each tool call with its result by call id (LEFT: unanswered calls stay)."""
    calls = messages.where(F.col("tool_calls").isNotNull()).select(
        *keys, F.col("turn").alias("call_turn"), F.explode("tool_calls").alias("c")
    ).select(*keys, "call_turn", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("tool"),
             F.col("c.function.arguments").alias("arguments"))
    results = messages.where(F.col("tool_call_id").isNotNull()).select(
        *keys, F.col("tool_call_id").alias("call_id"), F.col("turn").alias("result_turn"),
        F.col("text").alias("result"),
    )
    return calls.join(results, keys + ["call_id"], "left")


def execution_type(files: DataFrame, keys: list[str]) -> DataFrame:
    """P20: ``Multi-trajectory`` when the generation has an ``agent_execution/`` folder."""
    is_dir = F.col("rel_path").startswith(C.AGENT_EXECUTION_DIR + "/")
    return files.groupBy(*keys).agg(
        F.when(F.bool_or(is_dir), F.lit("Multi-trajectory")).otherwise(F.lit("Single")).alias("execution_type")
    )
