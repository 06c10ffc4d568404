"""The two ways to candidates, blocking and hybrid, behind one face: an index that is stored, and candidates with their scores' names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocking, features, index, retrieval, weighted


@dataclass(frozen=True)
class Path:
    """settings: their names and usual values; build(spark, targets, folder, settings), load(spark, folder), retrieve(queries, index, settings), named(features)."""

    settings: dict[str, int | None]
    build: Callable
    load: Callable
    retrieve: Callable
    named: Callable[[DataFrame], DataFrame]

    def complete(self, given: dict) -> dict:
        if unknown := sorted(given.keys() - self.settings.keys()):
            raise ValueError(f"settings of another path: {unknown}")
        found = self.settings | given
        if any(x is not None and x < 1 for x in found.values()):
            raise ValueError("sizes must be positive")
        return found

    def featured(self, queries: DataFrame, built, settings: dict) -> DataFrame:
        """All features of the candidates of prepared queries."""
        return self.named(features.rank_features(features.pair_features(self.retrieve(queries, built, settings), queries, built.records)))


PATHS = {
    "blocking": Path(
        {"cap": blocking.CAP, "candidates": blocking.TOP},
        lambda spark, targets, folder, s: index.build(spark, targets, folder, s["cap"]),
        index.load,
        lambda queries, built, s: index.retrieve(queries, built, n=s["candidates"]),
        features.blocking_names,
    ),
    "hybrid": Path(
        {"name_k": retrieval.TOP_NAME, "address_k": retrieval.TOP_ADDRESS, "words_k": retrieval.TOP_WORDS, "fit_sample": None, "max_features": None},
        lambda spark, targets, folder, s: weighted.build(spark, targets, folder, s["fit_sample"], s["max_features"]),
        weighted.load,
        lambda queries, built, s: weighted.retrieve(queries, built, s["name_k"], s["address_k"], s["words_k"]),
        lambda rows: rows,
    ),
}


def index_for(spark: SparkSession, path: Path, targets: DataFrame | None, trained: str, own: str, settings: dict, digest: Callable[[DataFrame], str]):
    """(the index of targets, its folder): that of the training where it holds the same targets, or none are given; else one of its own, built or completed."""
    if targets is None or index.manifest(spark, trained)["targets"] == digest(targets):
        return path.load(spark, trained), trained
    return path.build(spark, targets, own, settings), own
