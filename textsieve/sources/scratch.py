"""Folders for what a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can both write, under spark.checkpoint.dir. Where that is unset, a local session
    takes a folder of its machine; a cluster has to name one. It goes at the end of the driver's process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="textsieve-"))
    path = f"{base}/textsieve-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)
    except Exception:  # the session may be gone already
        pass
