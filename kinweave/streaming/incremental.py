"""Incremental scoring: files of queries arrive, each micro-batch is matched against a fixed index, results are committed per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import blocking, features
from ..operators.index import Index, build, kept
from ..operators.model import LINEAR, linear_score
from ..sources.tables import FIELDS

SCHEMA = ", ".join(f"{c} string" for c in FIELDS)


def match_batch(queries: DataFrame, index: Index, threshold: float, pool: int = blocking.POOL) -> DataFrame:
    """source1_entity_id, candidate_entity_ids, matched_entity_ids of every query; queries don't depend on each other."""
    prepared = blocking.prepare(queries)
    keys, ids = blocking.blocking_keys(prepared), queries.select(F.col("entity_id").alias("q"))
    candidates = blocking.voted(keys, index.usable, pool, ids, "right").select("q", F.array_join(blocking.sorted_ids(), ",").alias("candidate_entity_ids"))
    asking = blocking.voted(keys, index.usable, pool, blocking.of_side("q", prepared, features.LINEAR_COLUMNS))
    scored = features.measured(asking, prepared, index.records, LINEAR, features.LINEAR_COLUMNS).select("q", "t", linear_score().alias("probability"))
    matches = scored.where(F.col("probability") >= threshold).groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("m"))  # only matches are dealt by query
    return candidates.join(matches, "q", "left").select(F.col("q").alias("source1_entity_id"), "candidate_entity_ids", F.coalesce("m", F.lit("")).alias("matched_entity_ids"))


class Progress(StreamingQueryListener):
    """Tells of each batch how many queries are done, how many a second, and how long the rest of ``total`` will take."""

    def __init__(self, tell: Callable[[str], None], total: int | None = None):
        self.tell, self.total, self.done = tell, total, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.done += p.numInputRows
        if p.numInputRows:
            rate = max(p.processedRowsPerSecond, 1e-9)
            left = f", {max(0, self.total - self.done) / rate:.0f} s left" if self.total else ""
            self.tell(f"batch {p.batchId}: {self.done} queries, {rate:.1f} a second{left}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run(spark: SparkSession, incoming: str, targets: DataFrame, folder: str, cap: int = blocking.CAP, threshold: float = 0.5, settings: dict | None = None, pool: int = blocking.POOL) -> None:
    """Scores all files of queries (Parquet) in ``incoming`` that no earlier run has scored, to ``folder``/results, a folder a batch.

    The targets are indexed once, in ``folder``/index. Other targets or settings than an earlier run's are an error. A batch that
    is run again overwrites its own folder, so results are there once.
    """
    kept(spark, f"{folder}/settings", {"cap": cap, "threshold": threshold, "pool": pool} | (settings or {}))
    index = build(spark, targets.select(FIELDS), f"{folder}/index", cap)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(FIELDS).persist()  # keys, features and the result look at it
        match_batch(batch, index, threshold, pool).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(SCHEMA).parquet(incoming)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
