"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new folder only in local mode, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    return path.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
