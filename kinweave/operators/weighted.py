"""A persistent weighted index of targets for the hybrid path: for each method its terms with their statistics, and the inverted lists.

Lists are sorted by country and term, so a few queries' terms prune most of a file; a term's rows stand by falling weight, and
its greatest weight is kept with its statistics. Every part counts once Spark has committed it, so a build that was stopped
goes on with the parts that lack. A manifest holds a fingerprint of the targets and the settings; others are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checked, fingerprint
from .blocking import prepare
from .index import exists, kept, manifest
from .retrieval import METHODS, Fitted, found_by, populations, sizes_of, union

VERSION = 1


@dataclass
class Weighted:
    """records: prepared targets; of each method what it was fitted to, and (country_key, term, id, w)."""

    records: DataFrame
    methods: dict[str, tuple[Fitted, DataFrame]]


def parts() -> list[str]:
    return ["records", *(f"{name}/{part}" for name in METHODS for part in ("terms", "population", "lists", "greatest"))]


def missing_parts(spark: SparkSession, folder: str) -> list[str]:
    return [part for part in parts() if not exists(spark, f"{folder}/{part}/_SUCCESS")]


def build(spark: SparkSession, targets: DataFrame, folder: str, sample: int | None = None, most: int | None = None) -> Weighted:
    """The index of targets in folder, built or completed; sample and most bound what the methods are fitted on and the terms they know.

    Repeated or empty ids, or no rows, raise before anything is written; so do targets or settings other than those of an
    earlier build.
    """
    targets = checked(targets)
    kept(spark, f"{folder}/manifest", {"version": VERSION, "sample": sample, "most": most, "targets": fingerprint(targets)})
    lacking = set(missing_parts(spark, folder))

    def stored(part: str, rows) -> DataFrame:
        if part in lacking:
            rows().write.mode("overwrite").parquet(f"{folder}/{part}")
        return spark.read.parquet(f"{folder}/{part}")

    records = stored("records", lambda: prepare(targets))
    for name, method in METHODS.items():
        fit = method.fit(records, sample, most)
        known = Fitted(stored(f"{name}/terms", lambda f=fit: f.terms), stored(f"{name}/population", lambda f=fit: f.population))
        weights = lambda m=method, k=known: m.of_targets(m.counts(records), k)
        # rows of one term, which may be a large part of all, are parted by weight and id
        order = ["country_key", "term", F.desc("w"), "id"]
        lists = stored(f"{name}/lists", lambda w=weights, o=order: w().repartitionByRange(*o).sortWithinPartitions(*o))
        stored(f"{name}/greatest", lambda x=lists: x.groupBy("country_key", "term").agg(F.max("w").alias("greatest")))
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Weighted:
    if manifest(spark, folder)["version"] != VERSION or (lacking := missing_parts(spark, folder)):
        raise ValueError(f"the index is of another version or not complete: {lacking}")
    read = lambda part: spark.read.parquet(f"{folder}/{part}")
    return Weighted(read("records"), {name: (Fitted(read(f"{name}/terms"), read(f"{name}/population")), read(f"{name}/lists")) for name in METHODS})


def retrieve(queries: DataFrame, index: Weighted, k_name: int, k_address: int, k_words: int) -> DataFrame:
    """(q, t, char_name, char_address, bm25, retrieval_methods) of prepared queries; only the lists of their terms are read on."""
    population, found = populations(index.records), {}
    for name, n in sizes_of(k_name, k_address, k_words).items():
        known, lists = index.methods[name]
        asked = METHODS[name].counts(queries).select("country_key", "term").distinct()
        found[name] = found_by(METHODS[name], queries, lists.join(asked, ["country_key", "term"], "left_semi"), known, population, n)
    return union(found)
