"""Embedding whitening by a bidiagonal qd solver.

1. *Rows.*  Every entry c becomes the long floor(64 c) + 1000000; the *fit list* holds each
   distinct vector once and is written, since three passes read it.
2. *Sums.*  Count and sums per dimension, exact.  A centred row is (n x - S) / n, whose
   numerator is exact too, so nothing is lost by cancellation.
3. *Blockwise QR.*  Each task reduces its centred rows to one triangle, block by block;
   triangles are merged in rounds of ``FAN``, each one task's bounded work, until one is left.
4. *Solver* (``bidiagonal``): Householder bidiagonalisation, dqds for the values, twisted
   factorisations for the directions, on one triangle of the dimension's size.
5. *Projection* of all rows, and one pass over the fit list that measures the covariance of
   what was whitened.

Only the triangle, the sums and the directions (dimension times components) leave or
reach a task; no table passes the driver.

Defined results: rows whose vector is null or holds a null or non-finite entry are
dropped.  The dimension is the most frequent length among distinct vectors (the smaller of two
equally frequent); vectors of other lengths, empty ones included, are dropped as well.
Entries beyond 2^40 in size are taken as 2^40.  A direction without variance can't be
whitened, so there are as many components as the covariance has rank, ``components`` at
most; without any (no rows, or one distinct vector) the result is empty.  A deviation
beyond a long is null.  Repeated rows and repeated or null ids each give their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bidiagonal import principal
from .common import release, table, written

SCALE, OFFSET, LARGEST = 64, 1_000_000, float(2**40)
COMPONENTS = 16
#: Rows that a QR takes at once, triangles that a task merges, and bytes that these may hold.
ROWS, FAN, FAN_BYTES = 2048, 32, 1 << 26


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and has only finite entries."""
    one = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(one(c.cast("double")), F.lit(False))), F.lit(False))


def scaled(vector: Column) -> Column:
    """The entries as longs."""
    bound = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(bound(c.cast("double") * SCALE)) + OFFSET)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(fit: DataFrame) -> tuple[int, int, np.ndarray]:
    """The dimension, the number of vectors of it and their sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = np.diff(x.offsets.to_numpy())
            flat = x.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(sizes, sizes)
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = flat[of == d].reshape(-1, d)
                got = held.setdefault(d, [0, np.zeros(d, dtype=np.int64)])
                got[0] += len(rows)
                got[1] += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))], names=["d", "n", "s"])

    parts = written(fit.mapInArrow(sums, "d int, n long, s array<long>"), "whitening-sums")
    most = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return 0, 0, np.zeros(0, dtype=np.int64)
    at = parts.where(F.col("d") == most.d).select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return most.d, most.n, np.array([s for _, s in sorted(tuple(r) for r in at)], dtype=np.int64)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _reduced(fit: DataFrame, d: int, n: int, s: np.ndarray) -> np.ndarray:
    """A triangle R with R'R the centred rows' matrix of products."""

    def whole(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                r = _triangle(np.vstack([r, (n * x[at:at + ROWS] - s) / n]))
        if len(r):
            yield whole(r)
        release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for one in batch.column(0):
                r = _triangle(np.vstack([r, np.frombuffer(one.as_py()).reshape(-1, d)]))
        if len(r):
            yield whole(r)

    fan = max(2, min(FAN, FAN_BYTES // (8 * d * d)))
    parts = written(fit.mapInArrow(local, "r binary"), "whitening-triangles")
    left = parts.count()
    while left > 1:
        parts = written(parts.repartition(-(-left // fan)).mapInArrow(merged, "r binary"), "whitening-triangles")
        left = parts.count()
    return np.frombuffer(parts.first().r).reshape(-1, d)


def _identity_error(fit: DataFrame, d: int, n: int, s: np.ndarray, axes: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    c = axes.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((c, c)), np.zeros(c)
        for batch in batches:
            w = ((n * _matrix(batch.column(0), d) - s) / n) @ axes
            total += w.T @ w
            sums += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([[*sums, *total.ravel()]], pa.list_(pa.float64()))], names=["p"])

    got = fit.mapInArrow(products, "p array<double>").select(F.posexplode("p")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    p = np.array([v for _, v in sorted(tuple(r) for r in got)])
    mean = p[:c] / n  # the rows are centred already, so this is the rounding of their sum
    return float(np.abs(p[c:].reshape(c, c) / n - np.outer(mean, mean) - np.eye(c)).max())


def _deviations(z: np.ndarray) -> pa.Array:
    """Row sums of squares, exact."""
    d = z.shape[1]
    largest = int(np.abs(z).max(initial=0))
    if d * largest * largest < 2**63:
        return pa.array((z * z).sum(axis=1))
    exact = [sum(v * v for v in row) for row in z.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Per row with a whole vector and component: ``key, component, n, deviation, whitened,
    explained, identity_error``."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"_key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.where(is_whole(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("_key"), scaled(F.col(f"`{vector}`")).alias("x"))
    fit = written(rows.select("x").distinct(), "whitening-fit")
    d, n, s = _totals(fit)
    of_size = F.size("x") == d
    fit, rows = fit.where(of_size), rows.where(of_size)
    values, axes = principal(_reduced(fit, d, n, s)) if n else (np.zeros(0), np.zeros((0, 0)))
    if not len(values):
        return rows.where(F.lit(False)).select("_key", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")[1:]]) \
            .withColumnRenamed("_key", key)
    explained = values / values.sum()
    values, axes, explained = values[:components], axes[:, :components], explained[:components]
    axes = axes / np.sqrt(values / n)
    error = _identity_error(fit, d, n, s, axes)
    c = len(values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = part.num_rows
                z = n * _matrix(part.column(1), d) - s
                each = pa.array(np.repeat(np.arange(m), c))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * c, n, dtype=np.int64)), _deviations(z).take(each), pa.array(((z / n) @ axes).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))], names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(projected, schema).withColumnRenamed("_key", key)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: 16 whitened components of every whole vector of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
