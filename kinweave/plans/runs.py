"""Whole runs over files: train, benchmark, predict in parts, merge. Folders are of any store that Spark reads and writes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, features, index, metrics, model, outputs
from ..sources import tables
from .paths import PATHS, index_for

INFO = {"candidates": ["source1_entity_id", "candidate_entity_ids"], "matches": ["source1_entity_id", "matched_entity_ids"]}


def sample_labelled(queries: DataFrame, truth: DataFrame, n: int, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """n of the queries that have a row in truth, the same ones in every run, and their rows of truth. All targets stay as distractors."""
    known = truth.select(F.col("source1_entity_id").alias("entity_id")).distinct()
    chosen = tables.hash_sample(queries.join(known, "entity_id", "left_semi"), "entity_id", n, seed)
    return chosen, truth.join(chosen.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def train(spark: SparkSession, queries: DataFrame, targets: DataFrame, truth: DataFrame, work: str, sample: int = 2000, folds: int = 3, trees: int = 30, rate: float = 0.15, path: str = "blocking", files: str | None = None, **settings: int | None) -> dict:
    """Indexes targets, finds candidates of a sample of labelled queries, cross-validates and tunes the threshold.

    path and settings are those of plans.paths; files, a digest of the files that were read, is kept with the models. Leaves in ``work``: index, pairs (Parquet), models, thresholds (CSV with a
    header) and metrics (JSON), which it returns.
    """
    way = PATHS[path]
    settings = way.complete(settings)
    built = way.build(spark, targets, f"{work}/index", settings)
    chosen, known = sample_labelled(queries, truth, sample)
    prepared, links = blocking.prepare(chosen), tables.truth_links(known)
    rows = metrics.labels(way.featured(prepared, built, settings), links)
    rows.write.mode("overwrite").parquet(f"{work}/pairs")  # read once for each fold and metric
    rows = spark.read.parquet(f"{work}/pairs")
    columns = features.model_columns(rows)
    models, scored = model.cross_validate(rows, columns, folds, trees, rate)
    scored.write.mode("overwrite").parquet(f"{work}/scored")
    scored = spark.read.parquet(f"{work}/scored")
    sweep = metrics.threshold_sweep(scored, known, links)
    sweep.coalesce(1).write.mode("overwrite").csv(f"{work}/thresholds", header=True)  # a row for each threshold
    best, recall = metrics.best_threshold(sweep).first(), metrics.candidate_recall(rows, known, links).first()
    about = {"path": path, "settings": settings, "columns": columns, "files": files}
    model.save(models, f"{work}/models", about | {"threshold": best.threshold})
    found = {"threshold": best.threshold, "macro_fbeta": best.macro_fbeta, "folds": len(models), "pairs": rows.count(), "queries": chosen.count()} | recall.asDict() | about
    write_json(spark, f"{work}/metrics", found)
    return found


def predict(spark: SparkSession, queries: DataFrame, work: str, out: str, part: int = 0, parts: int = 1, targets: DataFrame | None = None, batches: int = 1, tell: Callable[[str], None] | None = None, files: str | None = None) -> None:
    """Candidates and matches of the queries of one part, by a hash of their ids, to ``out``/part=<part>/batch=<batch>.

    Targets other than those of the training get an index in ``out``, built or completed. A part is worked off in batches; those
    that were committed by an earlier run are not done again. A run with other queries, targets, model or parts is refused; files, a
    digest of the files that were read, stands for the queries' rows where it is given.
    """
    if not 0 <= part < parts or batches < 1:
        raise ValueError("0 <= part < parts, and a batch at least, are needed")
    models, about = model.load(spark, f"{work}/models")
    way, settings = PATHS[about["path"]], about["settings"]
    built, folder = index_for(spark, way, targets, f"{work}/index", f"{out}/index", settings, lambda rows: tables.fingerprint(tables.checked(rows)))
    index.kept(spark, f"{out}/signature", {"parts": parts, "batches": batches, "model": about, "index": index.manifest(spark, folder), "queries": files or tables.fingerprint(queries.select(tables.FIELDS))})
    began, done = time.time(), 0
    for batch in range(batches):
        place = f"{out}/part={part}/batch={batch}"
        if index.exists(spark, f"{place}/_SUCCESS"):
            continue
        mine = queries.where(model.fold_of(F.col("entity_id"), parts * batches) == part * batches + batch)
        scored = model.ensemble(models, way.featured(blocking.prepare(mine), built, settings)).select("q", "t", "probability")
        lists = scored.groupBy("q").agg(*(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for c, n in ((F.col("t"), "c"), (F.when(F.col("probability") >= about["threshold"], F.col("t")), "m"))))
        ids = mine.select(F.col("entity_id").alias("q")).join(lists, "q", "left")
        ids.select(F.col("q").alias("source1_entity_id"), F.coalesce("c", F.lit("")).alias("candidate_entity_ids"), F.coalesce("m", F.lit("")).alias("matched_entity_ids")).write.mode("overwrite").parquet(place)
        done += 1
        if tell:
            each = (time.time() - began) / done
            tell(f"part {part}: batch {batch + 1} of {batches}, {each:.1f} s a batch, {each * (batches - batch - 1):.0f} s left")


def merge(spark: SparkSession, queries: DataFrame, out: str, targets: DataFrame | None = None) -> None:
    """All parts as two tab-separated files in the order of the ids, which then are validated; parts that lack, rows that lack, repeat or are too many, and findings raise."""
    about = read_json(spark, f"{out}/signature")
    places = {(i, b): f"{out}/part={i}/batch={b}" for i in range(about["parts"]) for b in range(about["batches"])}
    if lacking := sorted({i for (i, _), place in places.items() if not index.exists(spark, f"{place}/_SUCCESS")}):
        raise ValueError(f"parts are missing: {lacking}")
    rows = outputs.merge_parts(spark.read.parquet(*places.values()), queries).orderBy("source1_entity_id")
    for name, columns in INFO.items():
        outputs.write_tsv(rows.select(columns), f"{out}/{name}")
    if errors := outputs.validate(spark, f"{out}/matches", f"{out}/candidates", queries, targets)[0]:
        raise ValueError("; ".join(errors))


def benchmark(spark: SparkSession, queries: DataFrame, work: str, n: int = 1000, whole: int | None = None) -> dict:
    """Queries a second of retrieval and features for n queries, and the hours that ``whole`` queries would take."""
    about = model.about(spark, f"{work}/models")
    way, settings = PATHS[about["path"]], about["settings"]
    built = way.load(spark, f"{work}/index")
    chosen = blocking.prepare(tables.hash_sample(queries, "entity_id", n))
    began = time.time()
    way.featured(chosen, built, settings).write.format("noop").mode("overwrite").save()
    seconds, count = time.time() - began, chosen.count()
    rate = count / seconds
    return {"queries": count, "seconds": seconds, "queries_a_second": rate} | ({"hours": whole / rate / 3600} if whole else {})
