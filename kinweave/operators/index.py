"""A persistent index of targets: prepared records and, sorted by key, the postings of the usable blocks.

Records are dealt to shards by a hash of the id, as many as their number asks for. A shard's postings count once Spark has committed
them, so a build that was stopped goes on with the shards that lack; a manifest holds a fingerprint of the targets, and others are
refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checked, fingerprint
from . import blocking

#: Targets of a shard, about, and files that a shard's records are dealt to.
VERSION, SHARD, FILES = 2, 1_000_000, 8


@dataclass
class Index:
    """records: prepared targets; usable: (entity_id, key) of blocks of at most cap targets."""

    records: DataFrame
    usable: DataFrame
    cap: int


def in_plan(prepared: DataFrame, cap: int = blocking.CAP) -> Index:
    """An index that is not stored."""
    return Index(prepared, blocking.usable_blocks(blocking.blocking_keys(prepared), cap), cap)


def exists(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def kept(spark: SparkSession, path: str, value: dict) -> None:
    """Writes value to path once; raises if another one is there."""
    text = json.dumps(value, sort_keys=True)
    if exists(spark, f"{path}/_SUCCESS"):
        if spark.read.text(path).first().value != text:
            raise ValueError("it was begun with other input or settings")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def missing_shards(spark: SparkSession, folder: str, shards: int) -> list[int]:
    return [i for i in range(shards) if not exists(spark, f"{folder}/postings/shard={i}/_SUCCESS")]


def build(spark: SparkSession, targets: DataFrame, folder: str, cap: int = blocking.CAP, shards: int | None = None) -> Index:
    """The index of targets in folder, built or completed.

    Targets are read once and written prepared, dealt to shards of about SHARD rows or to as many as are asked for; postings are
    made of one shard after the other. Repeated or empty ids, or no rows, raise before anything is written; so do targets or
    settings other than those of an earlier build.
    """
    targets, known = checked(targets), manifest(spark, folder) if exists(spark, f"{folder}/manifest/_SUCCESS") else {}
    digest = fingerprint(targets)
    shards = shards or known.get("shards") or -(-int(digest.split("-")[0]) // SHARD)
    kept(spark, f"{folder}/manifest", {"version": VERSION, "cap": cap, "shards": shards, "targets": digest})
    if not exists(spark, f"{folder}/records/_SUCCESS"):
        shard = F.pmod(F.xxhash64("entity_id"), F.lit(shards)).cast("int")
        blocking.prepare(targets).withColumn("shard", shard).repartition(F.col("shard"), F.pmod(F.xxhash64(F.reverse("entity_id")), F.lit(FILES))).write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/records")
    # the records are read again, so that both parts of a shard hold the same rows; a shard is a folder, of which only its files are listed
    records = spark.read.parquet(f"{folder}/records")
    for i in missing_shards(spark, folder, shards):
        keys = blocking.blocking_keys(records.where(F.col("shard") == i).drop("shard"))
        keys.repartition("key").sortWithinPartitions("key", "entity_id").write.mode("overwrite").parquet(f"{folder}/postings/shard={i}")
    if not exists(spark, f"{folder}/usable/_SUCCESS"):
        postings = spark.read.parquet(f"{folder}/postings").drop("shard")
        blocking.usable_blocks(postings, cap).repartition("key").sortWithinPartitions("key", "entity_id").write.mode("overwrite").parquet(f"{folder}/usable")
    return load(spark, folder)


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first().value)


def load(spark: SparkSession, folder: str) -> Index:
    about = manifest(spark, folder)
    if about["version"] != VERSION or not exists(spark, f"{folder}/usable/_SUCCESS"):
        raise ValueError("the index is of another version or not complete")
    return Index(spark.read.parquet(f"{folder}/records").drop("shard"), spark.read.parquet(f"{folder}/usable").select("entity_id", "key"), about["cap"])


def retrieve(queries: DataFrame, index: Index, pool_size: int = blocking.POOL, n: int = blocking.TOP) -> DataFrame:
    """Candidates of prepared queries: votes, a pool, and the best n by similarity."""
    return blocking.reranked(blocking.voted(blocking.blocking_keys(queries), index.usable, pool_size, blocking.of_side("q", queries, blocking.RANKED)), queries, index.records, n)
