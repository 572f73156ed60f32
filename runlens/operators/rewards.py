"""Reward arithmetic of weights mode.

The reference specifies these as text; here they are DataFrame jobs over graded
rollouts and trajectories.  Groups are rollouts of one question (the spec's
group size is 8), so windows over a group are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import WS_CLASS
from .sequence import ordinal


def group_advantage(rollouts: DataFrame, group: list[str], reward: str = "reward") -> DataFrame:
    """``reward - mean(reward)`` within each rollout group.

    The group mean is a partial (map-side combined) aggregate joined back on the
    group key, so a group with very many rollouts is never one task's window;
    AQE's skew join splits it on the big side.
    """
    means = rollouts.groupBy(*group).agg(F.avg(reward).alias("_mean"))
    return rollouts.join(means, group).withColumn(
        "advantage", F.round(F.col(reward) - F.col("_mean"), 6)).drop("_mean")


def has_solution_field(text: Column) -> Column:
    """Format check of the open-answer task: a ``solution =`` field is present."""
    return F.coalesce(text.rlike(rf"(?i)solution{WS_CLASS}*="), F.lit(False))


def step_reward(text: Column, format_ok: Column) -> Column:
    """W7 per step: +-0.5 format, -0.01 per turn, -0.3 when the text says 'hallucinate'."""
    fmt = F.when(format_ok, F.lit(C.FORMAT_REWARD_OK)).otherwise(F.lit(C.FORMAT_REWARD_BAD))
    hall = F.when(F.coalesce(F.contains(text, F.lit(C.HALLUCINATION_WORD)), F.lit(False)),
                  F.lit(C.HALLUCINATION_PENALTY)).otherwise(F.lit(0.0))
    return fmt + F.lit(C.PER_TURN_PENALTY) + hall


def episode_rewards(steps: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """Per episode, the sum of step rewards plus the final 1/0 correctness reward.

    ``steps``: keys + text (one row per agent step); ``graded``: keys + correct.
    Episodes without a grade get the wrong-answer reward.
    """
    per = steps.select(*keys, step_reward(F.col("text"), has_solution_field(F.col("text"))).alias("r"))
    agg = per.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("steps"),
                                 F.sum(F.col("r").cast("decimal(12,4)")).alias("_step"))
    g = graded.select(*keys, F.col("correct").alias("_ok"))
    j = agg.join(g, keys, "left")
    final = F.when(F.coalesce(F.col("_ok"), F.lit(False)), F.lit(C.FINAL_REWARD_CORRECT)).otherwise(
        F.lit(C.FINAL_REWARD_WRONG))
    return j.select(
        *keys, "steps",
        F.round(F.col("_step").cast("double"), 6).alias("step_reward"),
        final.alias("final_reward"),
        F.round(F.col("_step").cast("double") + final, 6).alias("total_reward"),
    )


def assign_batches(tasks: DataFrame, partition: list[str], order: list[str], size: int = C.BATCH_SIZE) -> DataFrame:
    """``ceil(n/size)`` batches in order, numbered from 0, within each partition.

    Numbered with the skew-safe ordinal (``operators.sequence``): a partition
    (a run's task list) may be large, so it is never sorted in one task.
    ``order`` must be unique within a partition.
    """
    numbered = ordinal(tasks, partition, order, name="_ord")
    return numbered.withColumn("batch", F.floor((F.col("_ord") - 1) / size).cast("bigint")).drop("_ord")
