"""Session defaults and shared-storage helpers."""
from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import SparkSession

# Settings every operator relies on: UTC timestamps (fixtures and day bins are
# defined in UTC), AQE for runtime coalescing and skew splitting.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that operators depend on (idempotent)."""
    for k, v in RUNTIME_DEFAULTS.items():
        if spark.conf.get(k, None) != v:
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a shared cluster: leave as is
                pass
    return spark


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "fabspark", extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, use the session you are given
    and call :func:`configure` instead."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("FABSPARK_DRIVER_MEMORY", "16g"))
          .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"))
    for k, v in {**RUNTIME_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location is read from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir). Where neither is set, a local[...] session gets a folder of
    its own; on several machines no such folder would be shared, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/fabspark-ckpt-{uuid.uuid4().hex[:8]}"
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (as an archive), for clusters whose
    workers do not have it installed."""
    import shutil
    import tempfile
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "fabspark"), "zip",
                                  os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    shared_dir(df.sparkSession, "ckpt")  # makes sure a checkpoint dir is set
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that end inside drop their shuffle files at once; else they lie until the driver collects its garbage, which
    it does here for what earlier queries left. For queries whose result is kept (a checkpoint, a file): one that is asked
    again would shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.sparkContext._jvm.System.gc()
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


ROWS_A_PART = 5_000                  # rows of a part, where the number of rows is known


def in_parts(df, rows: int):
    """``rows`` rows, about, in no more parts than they fill."""
    return df.coalesce(max(1, -(-rows // ROWS_A_PART)))


def cut_computed(df, rows: int | None = None):
    """``cut_lineage`` for columns computed by lambdas: on a checkpoint of such a projection, or of a union of them, the
    planner fails over constraints that name columns below it ("key not found"). Cached, the rows have a plan without
    constraints; the cache goes as soon as the checkpoint stands. ``rows``: how many there are, about, so that few
    of them do not lie in a part for each shuffle partition."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return cut_lineage(df)
    if rows is not None:
        df = in_parts(df, rows)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cut_lineage(held)
    finally:
        held.unpersist()
