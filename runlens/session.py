"""Spark session helpers.

The library itself never creates or reconfigures a session: every operator takes
DataFrames and returns DataFrames.  These helpers exist for tests, the bench and
local experiments, and for the two places that need a durable folder
(checkpoints and streaming state), which must come from the cluster's own
``spark.checkpoint.dir`` setting.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "runlens") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster the folder is set by the deployment (a shared filesystem); where it is
    unset there, this is an error, since other machines could not read a local folder.
    Only a local master (tests, the bench) gets a folder of its own.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session: the server reads the conf
        return current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def state_location(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for one streaming query."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
