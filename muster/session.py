"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Keeps the state of streams on local disk with checkpoints, not in the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    # Wall-clock times are compared across files and streams: one fixed zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Re-plan joins from measured sizes, split skewed partitions, merge small ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # Closes sessions map-side before the shuffle in streaming session windows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def session(app: str = "muster", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset. ``spark.sql.shuffle.partitions`` is the
    caller's: size it so that one partition of the largest shuffle is 128-256 MB
    (AQE merges the surplus of the smaller ones).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for ``name`` under the session's ``spark.checkpoint.dir``.

    Every executor must reach it, so a machine-local folder is made up only for
    a local session that sets none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
