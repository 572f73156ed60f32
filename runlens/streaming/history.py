"""ST4: an append-only history table for ``foreachBatch``, with a manifest.

* Each micro-batch writes its new generations to a folder of its own and then commits by
  writing one manifest version, a single small file that appears by a rename: the
  folders that make up the table from then on.  A folder that no version names is not
  part of the table, so a batch that failed between write and commit leaves nothing.
* A batch is made from the version before it, whatever later versions say, so delivering
  it again writes the same rows and the same version.
* Every folder has a *key filter* in the manifest: the buckets that its generations' hashes fall
  into.  A batch is compared only with folders that share a bucket with it; folders of more than
  ``FILTER_KEYS`` generations have no filter and are always compared.  The comparison is an
  anti join on the keys, so the result does not depend on the filters.
* Once ``compact_after`` folders of a level have come together, they are merged into one
  of the next level: the manifest stays logarithmic in the batches, and a row is
  rewritten once a level.  ``vacuum`` removes what no recent version names.

The table has one writer, the streaming query.  The only read error that counts as "no
table yet" is a manifest path that does not exist; any other fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a key filter, and generations of a folder up to which it has one.
BUCKETS, FILTER_KEYS = 1 << 16, 4096
MANIFEST = "_manifest"
MANIFEST_SCHEMA = "v long, folder string, level int, n long, buckets array<int>"


class HistoryTable:
    def __init__(self, path: str, keys: list[str], compact_after: int = 16):
        self.path, self.keys, self.compact_after = path.rstrip("/"), list(keys), compact_after

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.keys]), F.lit(BUCKETS)).cast("int")

    def versions(self, spark: SparkSession) -> DataFrame:
        """All manifest versions; empty where the table does not exist yet."""
        try:
            return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/{MANIFEST}").select("v", "folder", "level", "n", "buckets")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], MANIFEST_SCHEMA)

    def folders(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The folders of the newest version (of those before batch ``before``)."""
        all_of = self.versions(spark)
        if before is not None:
            all_of = all_of.where(F.col("v") < before)
        newest = all_of.agg(F.max("v")).first()[0]
        return all_of.where(F.col("v") == newest) if newest is not None else all_of.where(F.lit(False))

    def _load(self, spark: SparkSession, folders: list[str], schema=None) -> DataFrame:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The rows of the table; None where nothing was ever committed."""
        names = [r.folder for r in self.folders(spark).select("folder").collect()]
        return self._load(spark, names) if names else None

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Writes the batch's generations that the table does not hold, and commits."""
        spark = batch.sparkSession
        live = self.folders(spark, before=batch_id).drop("v")
        rows = batch.dropDuplicates(self.keys)
        theirs = rows.select(self._bucket().alias("b")).distinct()
        met = live.select("folder", F.explode("buckets").alias("b")).join(theirs, "b", "left_semi").select("folder")
        # folder names, a logarithmic number of the batches
        candidates = [r.folder for r in met.unionByName(live.where("buckets IS NULL").select("folder")).distinct().collect()]
        if candidates:
            known = self._load(spark, candidates, rows.schema).select(*self.keys)
            same = [rows[c].eqNullSafe(known[c]) for c in self.keys]
            rows = rows.join(known, [c for c in same], "left_anti")
        folder = f"batch={batch_id}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        manifest = live.unionByName(self._entry(spark, folder, 0))
        self.commit(self._compacted(spark, manifest, batch_id), batch_id)

    def _entry(self, spark: SparkSession, folder: str, level: int) -> DataFrame:
        """The manifest row of a folder that was written."""
        rows = self._load(spark, [folder])
        n, buckets = F.count(F.lit(1)), F.count_distinct("b")
        counted = rows.select(self._bucket().alias("b")).agg(n.alias("n"), buckets.alias("d")).first()
        # at most FILTER_KEYS numbers
        held = [r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()] if counted.n <= FILTER_KEYS else None
        return spark.createDataFrame([(folder, level, counted.n, held)], "folder string, level int, n long, buckets array<int>")

    def _compacted(self, spark: SparkSession, manifest: DataFrame, batch_id: int) -> DataFrame:
        entries = manifest.select("folder", "level").collect()
        level = 0
        while True:
            of_level = sorted(e.folder for e in entries if e.level == level)
            if len(of_level) < self.compact_after:
                return manifest
            merged = f"merged={batch_id}-{level + 1}"
            self._load(spark, of_level).write.mode("overwrite").parquet(f"{self.path}/{merged}")
            manifest = manifest.where(~F.col("folder").isin(of_level)).unionByName(self._entry(spark, merged, level + 1))
            entries = manifest.select("folder", "level").collect()
            level += 1

    def commit(self, manifest: DataFrame, batch_id: int) -> None:
        """One file, so the version appears at once or not at all."""
        rows = manifest.select(F.lit(batch_id).cast("long").alias("v"), "folder", "level", "n", "buckets")
        # the manifest may hold what is overwritten: it is a few rows, made whole first
        made = rows.sparkSession.createDataFrame(rows.collect(), MANIFEST_SCHEMA)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{MANIFEST}/batch={batch_id}")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Removes manifest versions but the newest ``keep``, and folders that none of these
        names.  Not while a batch is being written."""
        every = self.versions(spark)
        kept = [r.v for r in every.select("v").distinct().orderBy(F.desc("v")).limit(keep).collect()]
        if not kept:
            return []
        old = [r.v for r in every.where(~F.col("v").isin(kept)).select("v").distinct().collect()]
        live = {r.folder for r in every.where(F.col("v").isin(kept)).select("folder").distinct().collect()}
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [s.getPath().getName() for s in fs.listStatus(root)]
        gone = [f for f in there if f.startswith(("batch=", "merged=")) and f not in live]
        for name in [*(f"{MANIFEST}/batch={v}" for v in old), *gone]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        return sorted(gone)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function."""
        return self.append
