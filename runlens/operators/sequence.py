"""Numbering and choosing rows within groups without one task per group.

``ordinal`` is ``row_number() OVER (PARTITION BY g ORDER BY o)`` as a segmented scan
(``segments``): a group that holds a third of the rows is numbered by a third of the
tasks.  ``top_k_per_group`` ranks in two salted stages; ``first_per_group`` is for groups
that are small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import Segments


def ordinal(df: DataFrame, group: list[str], order: list[str | Column], name: str = "ordinal",
            partitions: int | None = None) -> DataFrame:
    """``df`` with each row's number in its group; ``order`` is a total order within one."""
    return Segments.of(df, group, order, partitions).scan(number=name)


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each small group by ``order`` (a group's candidate files,
    one question's duplicates): a window over the group, no struct ordering
    aggregate (which would sort every row)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def top_k_per_group(df: DataFrame, group: list[str], order: list[str], k: int, salt: int = 32,
                    rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, without one task per group.

    Stage 1 keeps the top ``k`` of each (group, salt) slice -- a hot group is
    split ``salt`` ways; stage 2 ranks the at most ``k * salt`` survivors of each
    group.  Exact: the group's top ``k`` is inside the union of the slices' top
    ``k``.  ``order`` must be a total order within a group.
    """
    h = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(salt))
    s1 = df.withColumn("_salt", h)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    c = s1.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    if not group:
        raise ValueError("top_k_per_group needs at least one group column")
    w2 = Window.partitionBy(*group).orderBy(*order)
    out = c.withColumn("_rk", F.row_number().over(w2)).where(F.col("_rk") <= k)
    return out.withColumnRenamed("_rk", rank) if rank else out.drop("_rk")
