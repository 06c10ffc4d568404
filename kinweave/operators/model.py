"""Grouped cross-validation of a boosted classifier, its ensemble, and a linear score that needs no training."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import trees
from .trees import Forest, Growth, boosted, with_chance

SEED, POSITIVE_WEIGHT = 2026, 4.0


def fold_of(q: Column, k: int) -> Column:
    """All pairs of a query are of one fold."""
    return F.pmod(F.conv(F.substring(F.md5(q), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")


def dealing(histogram: dict[int, int], k: int) -> list[tuple[int, list[int], list[int]]]:
    """How groups are dealt to k folds, the largest first, each to the fold with the fewest rows so far (of equal ones the first).

    From the numbers of groups of each size: a row for each size, with the folds of its first groups, and those of all others, which
    repeat: once folds differ by less than the size, each in turn is the smallest.
    """
    loads, out = [0] * k, []
    for size, count in sorted(histogram.items(), reverse=True):
        first = []
        while len(first) < count and max(loads) - min(loads) >= size:
            first.append(loads.index(min(loads)))
            loads[first[-1]] += size
        cycle = sorted(range(k), key=lambda f: (loads[f], f))
        rounds, rest = divmod(count - len(first), k)
        for place, f in enumerate(cycle):
            loads[f] += size * (rounds + (place < rest))
        out.append((size, first, cycle))
    return out


def balanced_folds(groups: DataFrame, k: int) -> DataFrame:
    """(q, n, fold) of groups (q, n), n the rows of a group: folds differ by the rows of one group at most, and all rows of a group are of one fold.

    Groups of one size are dealt in the order of their digests. Only the numbers of groups of each size come to the driver; an
    order among all groups of a size is made of small ones, by the first digits of the digests.
    """
    keyed = groups.select("q", F.col("n").cast("long").alias("n"), F.md5("q").alias("digest")).withColumn("part", F.substring("digest", 1, 4))
    parts = keyed.groupBy("n", "part").agg(F.count("*").alias("many"))
    before = parts.select("n", "part", (F.sum("many").over(Window.partitionBy("n").orderBy("part")) - F.col("many")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("n", "part").orderBy("digest", "q")) - 1
    histogram = {r.n: r.many for r in parts.groupBy("n").agg(F.sum("many").alias("many")).collect()}
    table = groups.sparkSession.createDataFrame(dealing(histogram, k), "n long, first array<int>, cycle array<int>")
    later = F.get("cycle", ((F.col("place") - F.size("first")) % k).cast("int"))
    dealt = keyed.join(before, ["n", "part"]).withColumn("place", place).join(F.broadcast(table), "n")
    return dealt.select("q", "n", F.when(F.col("place") < F.size("first"), F.get("first", F.col("place").cast("int"))).otherwise(later).alias("fold"))


def folds_for(rows: DataFrame, wanted: int) -> int:
    groups, classes = rows.agg(F.count_distinct("q"), F.count_distinct("label")).first()
    if classes < 2:
        raise ValueError("labels of both classes are needed")
    return min(wanted, groups)


def cross_validate(rows: DataFrame, columns: list[str], folds: int = 3, trees: int = 30, rate: float = Growth.rate) -> tuple[list[Forest], DataFrame]:
    """Forests, and (q, t, label, probability) of each row by the forest that has not seen its query.

    Training stops early on a tenth of the training queries, never on the fold that is scored.
    """
    k = folds_for(rows, folds)
    of = balanced_folds(rows.groupBy("q").agg(F.count("*").alias("n")), k).select("q", "fold")
    rows = rows.join(of, "q").withColumns({"weight": F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(1.0), "inner": fold_of(F.concat("q", F.lit("|inner")), 10) == 0})
    ones = {r.fold: (r.n, r.ones) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()}
    for i in range(k):
        others = [ones[f] for f in ones if f != i]
        if not 0 < sum(x for _, x in others) < sum(n for n, _ in others):
            raise ValueError(f"fold {i} leaves labels of one class")
    forests = boosted(rows, columns, k, Growth(trees=trees, rate=rate, seed=SEED))
    return forests, with_chance(rows.select("q", "t", "label", "fold", *columns), forests, by="fold").select("q", "t", "label", "probability")


def ensemble(models: list[Forest], rows: DataFrame) -> DataFrame:
    """rows with the mean probability of the models."""
    return with_chance(rows, models)


def save(models: list[Forest], folder: str, manifest: dict) -> None:
    spark = SparkSession.active()
    trees.save(models, spark, f"{folder}/forests")
    spark.createDataFrame([(json.dumps(manifest | {"folds": len(models)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def about(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first().value)


def load(spark, folder: str, expected: dict | None = None) -> tuple[list[Forest], dict]:
    """Models and manifest; settings that are expected and differ are an error."""
    manifest = about(spark, folder)
    if different := {k for k, v in (expected or {}).items() if manifest.get(k) != v}:
        raise ValueError(f"the model was made with other settings: {sorted(different)}")
    return trees.load(spark, f"{folder}/forests"), manifest


#: Features of the linear score.
LINEAR = ["name_edit", "name_jaccard", "address_jaccard", "digit_jaccard", "name_length_ratio"]


def linear_score() -> Column:
    """A fixed score in 0 to 1 of pairs with set features."""
    return F.round(0.35 * F.col("name_edit") + 0.25 * F.col("name_jaccard") + 0.2 * F.col("address_jaccard") + 0.1 * F.col("digit_jaccard") + 0.1 * F.col("name_length_ratio"), 9)
