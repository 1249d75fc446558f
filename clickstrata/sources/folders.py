"""Folders that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.lru_cache(maxsize=8)
def _of_this_machine(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="clickstrata-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where driver and executors are one process (tests) may it be absent: then a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder that executors share")
    found = _of_this_machine(spark.sparkContext.applicationId)
    _gone_at_exit(spark, found)
    return found


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def new_folder(spark: SparkSession, kind: str = "stage") -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _gone_at_exit(spark, path)
    return path
