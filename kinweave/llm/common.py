"""What the operators share: the shared folder, written tables and row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # on a cluster each machine would write to its own disk
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows that are sent to a Python worker together while a table is written: texts are long, and both sides hold a batch.
ARROW_ROWS, TEXTS_TOGETHER = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


class Scratch:
    """Written tables of one operator call, in the shared folder. They cut lineage, and a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, release: bool = True) -> DataFrame:
        path, schema, conf = f"{self.root}/{name}", df.schema, self.spark.conf
        usual = conf.get(ARROW_ROWS)
        conf.set(ARROW_ROWS, str(min(int(usual), TEXTS_TOGETHER)) if int(usual) > 0 else str(TEXTS_TOGETHER))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(ARROW_ROWS, usual)
        del df
        if release:  # shuffle files of what is written now are of no more use; Spark removes them when their owners are collected
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """run, a function for mapInArrow, that gives memory back to the system when a task's rows are done: workers outlive tasks."""

    def tidied(batches):
        yield from run(batches)
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


#: So many rows of a few numbers each (tens of megabytes) are broadcast; their count is looked up first.
FEW = 500_000


def with_few(rows: DataFrame, written: DataFrame, column: str) -> DataFrame:
    """rows joined with a written table on column. A table of at most FEW rows is broadcast, so that rows stay where they are; else both are shuffled."""
    return rows.join(F.broadcast(written) if written.count() <= FEW else written, column)


def row_key() -> Column:
    """64 bits that stand for a row of documents: equal rows share it, and a null id or text is a value like others."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce(F.col("text"), F.lit("")))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha_hex(c: Column) -> Column:
    return F.sha2(c, 256)
