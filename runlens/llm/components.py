"""Connected components of a table of links.

The links are first thinned: blocks of at most ``BLOCK_LINKS`` links, one a task, are
contracted to a forest whose trees are stars round their least node.  If one block
holds them all, that is the result.  Otherwise alternating stars go on from the
forests: each round points the larger neighbours of every node at its least neighbour
and then joins each node's smaller neighbours to the least of them, and the links
become stars round the least node of each component in a logarithmic number of
rounds.  The least neighbour is a grouped minimum, combined before its exchange, so a
node with very many links is no single task.  Every round is written to the shared
checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

BLOCK_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one block as stars ``(u, v)`` round the least node ``v`` of each tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])
    batch = nodes = None
    parent.clear()
    release()


def _least(links: DataFrame, with_self: bool) -> DataFrame:
    """Links ``(u, v)`` with ``m``, the least of ``u`` and its ``v``."""
    least = F.min("v")
    m = links.groupBy("u").agg((F.least(least, F.col("u")) if with_self else least).alias("m"))
    return links.join(m, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    # every node points at smaller ones now; keep the least, and join the others to it
    star = _least(large, False)
    return star.select("u", F.col("m").alias("v")).unionByName(
        star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, block: int | None = None) -> DataFrame:
    """``id, label`` for every node that has a link; the label is the component's least id."""
    block = block or BLOCK_LINKS
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    blocks = -(-max(edges.count(), 1) // block)
    edges = written(edges.coalesce(blocks).mapInArrow(_forest, "u long, v long"), "links")
    before = None
    while blocks > 1:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        edges = written(_round(edges), "links")
    # stars: a root is no u
    return edges.where("u <> v").select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
