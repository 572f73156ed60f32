"""Metric evaluators beyond the three graders (X1): ROC AUC, RMSE, Dice, ROUGE-L, silhouette.

Each takes rows of many (task, run, generation) groups at once.  A group may hold any share
of the rows: counts and sums are combined before their exchange, ranks are segmented
scans over distinct scores, and nothing gathers a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import small_side
from .segments import Segments

#: Cluster sums that are broadcast: clusters times groups.
MAX_CLUSTERS = 100_000
_TOKEN = r"[^\x20\x09-\x0D]+"


def roc_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, positives, negatives, auc`` of rows with ``score`` and ``positive``: the share
    of (positive, negative) pairs in which the positive scores higher, ties counting half.

    Rows are first counted by score, so ties cost nothing; the negatives below each score come
    from a segmented running sum.  Rows without a score or truth are left out; AUC is
    NULL where a group has no pair.
    """
    rows = scored.where(F.col("score").isNotNull() & F.col("positive").isNotNull())
    by_score = rows.groupBy(*keys, "score").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    below = Segments.of(by_score, keys, ["score"]).scan(before={"neg_below": "neg"})
    # twice the pairs won, exact
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    won = F.sum((wide("pos") * (wide("neg_below") * 2 + wide("neg"))).cast("decimal(38,0)"))
    out = below.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), won.alias("_won"))
    pairs = F.col("positives").cast("double") * F.col("negatives") * 2
    return out.select(*keys, "positives", "negatives", F.round(F.try_divide(F.col("_won").cast("double"), pairs), 9).alias("auc"))


def rmse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, rmse`` of rows with ``value`` and ``expected`` (numbers up to 2^31 in
    thousandths: the sum of squares is exact); rows without either are left out."""
    unit = lambda c: F.round(F.col(c).cast("decimal(20,3)"), 3)
    d = (unit("value") - unit("expected")).cast("decimal(16,3)")
    got = rows.where(F.col("value").isNotNull() & F.col("expected").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((d * d).cast("decimal(32,6)")).alias("_ss"))
    return got.select(*keys, "n", F.round(F.sqrt(F.col("_ss").cast("double") / F.col("n")), 6).alias("rmse"))


def dice(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, label, dice`` of rows with ``label`` (truth) and ``pred_label``: per class, twice
    the hits over truths plus predictions.  NULLs belong to no class."""
    marks = F.array(F.struct(F.col("label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                    F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    hit = (F.col("label") == F.col("pred_label")).alias("hit")
    each = rows.select(*keys, hit, F.explode(marks).alias("m")).where(F.col("m.label").isNotNull())
    n = each.groupBy(*keys, F.col("m.label").alias("label")).agg(
        F.sum("m.t").alias("t"), F.sum("m.p").alias("p"), F.count_if(F.col("hit") & (F.col("m.t") == 1)).alias("h"))
    return n.select(*keys, "label", F.round(F.col("h") * 2.0 / (F.col("t") + F.col("p")), 9).alias("dice"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, folding ``a`` over a bit row of ``b``."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hits = row & at.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(b) - row.bit_count()


def rouge_l(rows: DataFrame, keep: list[str], text: str = "text", expected: str = "expected") -> DataFrame:
    """``keep`` with ``lcs, precision, recall, f1`` of the words of a text against those
    expected; NULL is no words, and a score without words is 0.

    The fold is one helper a row (bit-parallel, so linear in one text per 64 words of the
    other); it returns a number, and the scores are expressions.
    """
    words = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(_TOKEN), 0)
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("lcs", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_expected", T.LongType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(a.as_py(), b.as_py()) for a, b in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True)]
            made = [[common_subsequence(a, b) for a, b in pairs], [len(a) for a, _ in pairs], [len(b) for _, b in pairs]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *[pa.array(m, pa.int64()) for m in made]], names=schema.names)

    got = rows.select(*keep, words(text).alias("_a"), words(expected).alias("_b")).mapInArrow(mapped, schema)
    lcs = F.col("lcs").cast("double")
    p = F.coalesce(F.try_divide(lcs, F.col("n_words")), F.lit(0.0))
    r = F.coalesce(F.try_divide(lcs, F.col("n_expected")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * lcs, F.col("n_words") + F.col("n_expected")), F.lit(0.0))
    return got.select(*keep, "lcs", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def silhouette(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (``keys, id, cluster, features array<double>``) with ``silhouette``, by squared
    Euclidean distances.

    The mean distance of a point to a cluster follows from the cluster's size, sum and sum of
    squared lengths, so points meet clusters, never points.  The sums are broadcast where
    there are at most ``MAX_CLUSTERS``, else joined by group.  A point alone in its cluster, or
    in the only one of its group, has 0; points without cluster or features are left out.
    """
    pts = points.where(F.col("cluster").isNotNull() & F.col("features").isNotNull())
    sq = _dot(F.col("features"), F.col("features"))
    each = pts.select(*keys, "cluster", F.posexplode("features").alias("i", "x"))
    sums = each.groupBy(*keys, "cluster", "i").agg(F.sum("x").alias("s"))
    # one row per cluster of at most the dimension's entries
    vectors = sums.groupBy(*keys, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("sum"))
    sizes = pts.select(*keys, "cluster", sq.alias("sq")).groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("sq_sum"))
    clusters = vectors.join(sizes, [*keys, "cluster"])
    group = clusters.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "n", "sum", "sq_sum")).alias("_clusters"))
    met = pts.withColumn("_sq", sq).join(small_side(group, MAX_CLUSTERS), keys)

    def mean(c: Column, n: Column) -> Column:
        return (c["n"] * F.col("_sq") + c["sq_sum"] - 2 * _dot(F.col("features"), c["sum"])) / n

    own = F.filter("_clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.array_min(F.transform(F.filter("_clusters", lambda c: c["cluster"] != F.col("cluster")), lambda c: mean(c, c["n"])))
    scored = met.select(*points.columns, own.alias("_own"), others.alias("_b"), "_sq")
    a = F.when(F.col("_own")["n"] > 1, F.greatest(mean(F.col("_own"), F.col("_own")["n"] - 1), F.lit(0.0)))
    scored = scored.select(*points.columns, a.alias("_a"), F.greatest("_b", F.lit(0.0)).alias("_b"), F.col("_b").isNull().alias("_only"))
    s = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    return scored.select(*points.columns, F.when(F.col("_only"), F.lit(0.0)).otherwise(F.round(s, 6)).alias("silhouette"))
