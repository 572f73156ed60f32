"""Segmented scans: ``lag``, running maxima and row numbers along groups of any size.

``max(x) OVER (PARTITION BY run ORDER BY gen)`` sorts a whole run in one task; a run that
holds a third of the rows becomes a third of the job on one core.  Here instead:

1. *Segments.*  Rows are range-partitioned on (group, order), so a hot group spans many
   partitions, and frozen once with ``checkpoint()`` in the cluster's checkpoint folder (two
   reads of a sampled range exchange need not cut alike).  A group's rows within a partition
   are a segment; rows of equal (group, order) share one.
2. *Local scan.*  Frozen rows go back to their own partitions by number (no hashing, so no two
   large segments fall into one task) and windows run inside segments.
3. *Carry.*  A segment is summarised to one row; a window over the segments of a group gives
   what each inherits from those before (or after) it.  Only groups that span several
   partitions need any: a partition holds parts of at most two such groups, so the carry
   table has at most two rows per partition, whatever the data, and is broadcast on that proof.
4. *Merge.*  Each row combines its local value with its segment's carry.

A scan is exact for any cut of the partitions.  ``order`` must be a total order within a
group where row numbers or previous values are asked for.  Groups may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LOCAL_BITS = 33       # of monotonically_increasing_id: the row's place in its partition
PID, LOC = "_pid", "_loc"


class Segments:
    """Rows of ``group`` in ``order``, frozen in range partitions."""

    def __init__(self, rows: DataFrame, group: list[str], partitions: int, placed: bool = False):
        """``placed``: the rows already are in the partitions that they name."""
        self.rows, self.group, self.partitions, self.placed = rows, list(group), partitions, placed

    @classmethod
    def of(cls, df: DataFrame, group: list[str], order: list[str | Column], partitions: int | None = None) -> Segments:
        if not group:
            raise ValueError("segments need at least one group column")
        spark = df.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        s = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order) \
            .withColumn("_mid", F.monotonically_increasing_id())
        s = s.withColumn(PID, F.shiftright("_mid", LOCAL_BITS).cast("int")) \
            .withColumn(LOC, F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))).drop("_mid")
        ensure_checkpoint_dir(spark)
        return cls(s.checkpoint(eager=True), group, n)

    @property
    def df(self) -> DataFrame:
        """The rows without their places."""
        return self.rows.drop(PID, LOC)

    def derive(self, change: Callable[[DataFrame], DataFrame]) -> Segments:
        """The same segments over rows made row by row (a projection, a filter, an
        explode); ``change`` keeps the group columns and the two columns of places."""
        return Segments(change(self.rows), self.group, self.partitions, self.placed)

    def scan(self, number: str | None = None, previous: dict[str, str] | None = None, best: dict[str, str] | None = None,
             following: dict[str, str] | None = None, first: dict[str, str] | None = None,
             before: dict[str, str] | None = None, places: bool = False) -> DataFrame:
        """The rows with scanned columns, each given as ``{new column: column}``:

        * ``number`` -- the row's number in its group, from 1;
        * ``previous`` -- the value of the row before;
        * ``best`` -- the greatest value so far, nulls passed over;
        * ``following`` -- the least value greater than the row's own (the column the
          segments are ordered by; an integer);
        * ``first`` -- the least value of the group, nulls passed over;
        * ``before`` -- the sum of the rows before this one, 0 for the first.

        ``places`` keeps the columns of places.
        """
        previous, best, following, first, before = (x or {} for x in (previous, best, following, first, before))
        g = self.group
        inside = Window.partitionBy(*g, PID)
        local = inside.orderBy(LOC)
        upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        short_of = local.rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*g).orderBy(PID)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)

        summary = {"_n": F.count(F.lit(1))}
        summary |= {f"_p_{k}": F.max_by(c, LOC) for k, c in previous.items()}
        summary |= {f"_b_{k}": F.max(c) for k, c in best.items()}
        summary |= {f"_f_{k}": F.min(c) for k, c in (following | first).items()}
        summary |= {f"_s_{k}": F.sum(c) for k, c in before.items()}
        parts = self.rows.groupBy(*g, PID).agg(*[v.alias(k) for k, v in summary.items()])
        carried = {"_c_n": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
        carried |= {f"_c_{k}": F.lag(f"_p_{k}").over(across) for k in previous}
        carried |= {f"_c_{k}": F.max(f"_b_{k}").over(earlier) for k in best}
        carried |= {f"_c_{k}": F.lead(f"_f_{k}").over(across) for k in following}
        carried |= {f"_c_{k}": F.min(f"_f_{k}").over(Window.partitionBy(*g)) for k in first}
        carried |= {f"_c_{k}": F.sum(f"_s_{k}").over(earlier) for k in before}
        carry = parts.select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col(PID).alias("_gp"),
            F.count(F.lit(1)).over(Window.partitionBy(*g)).alias("_parts"), *[v.alias(k) for k, v in carried.items()])
        carry = carry.where("_parts > 1").drop("_parts")

        scanned = {"_i": F.row_number().over(local)} if number or previous else {}
        scanned |= {f"_l_{k}": F.lag(c).over(local) for k, c in previous.items()}
        scanned |= {f"_l_{k}": F.max(c).over(upto) for k, c in best.items()}
        scanned |= {f"_l_{k}": F.min(c).over(inside.orderBy(c).rangeBetween(1, Window.unboundedFollowing)) for k, c in following.items()}
        scanned |= {f"_l_{k}": F.min(c).over(inside) for k, c in first.items()}
        scanned |= {f"_l_{k}": F.sum(c).over(short_of) for k, c in before.items()}
        rows = self.rows if self.placed else self.rows.repartitionById(self.partitions, PID)
        rows = rows.select("*", *[v.alias(k) for k, v in scanned.items()])
        same = F.col(PID) == F.col("_gp")
        for i, c in enumerate(g):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        rows = rows.join(F.broadcast(carry), same, "left")

        out = {}
        if number:
            out[number] = (F.col("_i") + F.coalesce(F.col("_c_n"), F.lit(0))).cast("bigint")
        out |= {k: F.when(F.col("_i") == 1, F.col(f"_c_{k}")).otherwise(F.col(f"_l_{k}")) for k in previous}
        out |= {k: F.greatest(f"_l_{k}", f"_c_{k}") for k in best}
        out |= {k: F.coalesce(f"_l_{k}", f"_c_{k}") for k in following}
        out |= {k: F.coalesce(f"_c_{k}", f"_l_{k}") for k in first}
        out |= {k: F.coalesce(f"_l_{k}", F.lit(0)) + F.coalesce(f"_c_{k}", F.lit(0)) for k in before}
        kept = [c for c in self.rows.columns if places or c not in (PID, LOC)]
        return rows.select(*kept, *[v.alias(k) for k, v in out.items()])

    def numbered(self, name: str) -> Segments:
        """The segments with the row's number in its group as column ``name``."""
        return Segments(self.scan(number=name, places=True), self.group, self.partitions, placed=True)


def segments(data: DataFrame | Segments, group: list[str], order: list[str | Column]) -> Segments:
    """``data`` as segments of ``group``: as it is where it has them."""
    return data if isinstance(data, Segments) else Segments.of(data, group, order)


def plain(data: DataFrame | Segments) -> DataFrame:
    return data.df if isinstance(data, Segments) else data
