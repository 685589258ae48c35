"""Spark session and shared-folder helpers.

Cluster settings (master, memory, ``spark.checkpoint.dir``) belong to whoever
launches the job.  The helpers here only fill in what is unset, so the same
code runs in tests on ``local[*]`` and on a cluster.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SHIPPING = threading.Lock()
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "attrition") -> SparkSession:
    """Return the active session, or build a local one for tests and tools."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ATTRITION_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a fresh
    scratch folder is registered if the driver and the tasks are one process
    (local tests); a cluster must name a folder that all its machines share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="attrition-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives
    executor loss) and return a DataFrame reading from it.

    The input is persisted for the duration of the call: a reliable
    checkpoint otherwise computes the plan twice (once for the eager count,
    once for the write)."""
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package where they would not find it: not
    installed and not on the search path that executors inherit.  Spark's own
    file server hands it out, once per application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    sc = spark.sparkContext
    with _SHIPPING:                   # fits run in threads
        if on_path or "site-packages" in root or any("attrition_package" in f for f in sc.listFiles):
            return
        folder = tempfile.mkdtemp(prefix="attrition-ship-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "attrition_package"), "zip", root, "attrition"))


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
