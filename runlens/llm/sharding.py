"""Sharding by a Feistel permutation over global row numbers.

A document's row number is its place in the order of its key.  A keyed Feistel
network permutes the numbers 0 to n - 1: it permutes the next power of four and
walks its cycles until it is back below n.  Position p goes to shard ``p mod k``
and slot ``p div k``, so shard sizes differ by one row at most, slots have no
gaps, and either direction is arithmetic: ``place`` gives a row's shard and slot,
``row_at`` gives the row number in a slot.  A seed gives one shuffle, on any
cluster and any partitioning.

Row numbers come from a range exchange of narrow rows (no texts): the sorted rows
are written once to the shared checkpoint folder with their partition and place
in it, and the counts per partition, as many as there are partitions, give the
offsets.  The last sort column spreads equal rows, so one key that holds a third
of all rows still covers many partitions; equal rows are interchangeable.

Defined results: null keys come first; null text has no bytes and checksum 0;
repeated rows get slots of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

SHARDS, SEED, ROUNDS = 40, 20240229, 6
OVERHEAD = 16


def _half_bits(n: int) -> int:
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def _round_keys(seed: int) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:8], "big")) for r in range(ROUNDS)]


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit mix of the half block and the round key (wraps by design)."""
    z = x ^ key
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _feistel(x: np.ndarray, bits: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mixed(left, key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, key) & mask)
    return (left << b) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0 to n - 1 (or its inverse) at ``numbers``."""
    bits, keys = _half_bits(n), _round_keys(seed)
    out = _feistel(numbers.astype(np.uint64), bits, keys, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _feistel(out[outside], bits, keys, back)
    return out.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    p = permute(numbers, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    return permute(np.asarray(slot, dtype=np.int64) * shards + shard, n, seed, back=True)


def numbered(rows: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """``rows`` with their global number by ``order``, and how many there are."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    kept = (spread.repartitionByRange(n_parts, *order, "_spread").sortWithinPartitions(*order, "_spread").drop("_spread")
            .withColumn("_at", F.monotonically_increasing_id())
            .withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    kept = written(kept, "row-numbers")
    counts = sorted((r._part, r.n) for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    before = kept.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    out = kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return out.drop("_part", "_at", "_before"), total


def assign(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (narrow rows: a key and what goes with it)."""
    found, n = numbered(rows, order)

    @F.pandas_udf(T.LongType())
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), max(n, 1), seed))

    p = found.withColumn("_p", position("row_no"))
    return p.select(*rows.columns, (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {int(shards)}").alias("slot"))


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder per shard, rows by slot."""
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` into 40 shards, counts at most one apart."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return assign(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
