"""Features of candidate pairs, and their ranks within a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.batch import SIMILARITIES, levenshteins_of
from . import cells
from .blocking import with_records

RETRIEVAL = ["char_name", "char_address", "bm25"]
#: Columns of prepared records that the features look at.
SET_COLUMNS = ["name_norm", "name_core", "address_norm", "core_tokens", "address_tokens", "digits", "country"]
#: Those of them that the features of the linear score look at.
LINEAR_COLUMNS = ["name_norm", "core_tokens", "address_tokens", "digits"]


def with_shared(pairs: DataFrame, q: str = "q_", t: str = "t_") -> DataFrame:
    """pairs with what several features look at, worked out once for each: shared_* (numbers of shared words and digit runs) and
    name_distance (edits from name to name)."""
    shared = {f"shared_{c}": F.size(F.array_intersect(f"{q}{c}", f"{t}{c}")) for c in ("core_tokens", "address_tokens", "digits")}
    return pairs.withColumns(shared).withColumn("name_distance", S.levenshtein_udf(f"{q}name_norm", f"{t}name_norm"))


def jaccard(a: Column, b: Column, shared: Column) -> Column:
    """Of arrays without repeats; 1 for two empty sets, 0 for one."""
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column, shared: Column) -> Column:
    """Of arrays without repeats; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(shared / F.greatest(least, F.lit(1)))


def length_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(longer, F.lit(1)))


def edit_similarity(a: Column, b: Column, distance: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - distance / F.greatest(longer, F.lit(1)))


def set_features(q: str = "q_", t: str = "t_") -> dict[str, Column]:
    """Features that are column expressions over SET_COLUMNS of both records and what with_shared adds."""
    c = lambda side, name: F.col(f"{side}{name}")
    both = lambda name: (c(q, name), c(t, name))
    flag = lambda condition: condition.cast("double")
    name, core, address = both("name_norm"), both("name_core"), both("address_norm")
    core_tokens, address_tokens, digits = ((*both(c), F.col(f"shared_{c}")) for c in ("core_tokens", "address_tokens", "digits"))
    exact = lambda pair: flag((pair[0] == pair[1]) & (pair[0] != ""))
    conflict = (F.size(digits[0]) > 0) & (F.size(digits[1]) > 0) & (digits[2] == 0)
    return {
        "name_edit": edit_similarity(*name, F.col("name_distance")), "name_jaccard": jaccard(*core_tokens), "name_containment": containment(*core_tokens),
        "address_jaccard": jaccard(*address_tokens), "address_containment": containment(*address_tokens), "digit_jaccard": jaccard(*digits), "digit_conflict": flag(conflict),
        "country_equal": flag(c(q, "country").eqNullSafe(c(t, "country"))), "name_exact": exact(name), "name_core_exact": exact(core), "address_exact": exact(address),
        "address_missing": flag(address[1] == ""), "name_length_ratio": length_ratio(*name), "address_length_ratio": length_ratio(*address),
        "same_target_source": F.when(F.col("t").startswith("S2-"), 2.0).otherwise(3.0),
    }


def set_measures(pairs: cells.Pairs) -> dict[str, Callable[[], np.ndarray]]:
    """The features of set_features over pairs in a cell, each worked out when asked for."""

    def share(of: np.ndarray, whole: np.ndarray, none: float) -> np.ndarray:
        return np.where(whole == 0, none, of / np.maximum(whole, 1))

    def shared(column: str) -> np.ndarray:
        return pairs.once(column, lambda: pairs.shared(column))

    def jaccard(column: str) -> np.ndarray:
        a, b = pairs.counts(column)
        return share(shared(column), a + b - shared(column), 1.0)

    def containment(column: str) -> np.ndarray:
        return share(shared(column), np.minimum(*pairs.counts(column)), 0.0)

    def length_ratio(column: str) -> np.ndarray:
        return share(np.minimum(*pairs.lengths(column)), np.maximum(*pairs.lengths(column)), 1.0)

    def edit() -> np.ndarray:
        longer = np.maximum(*pairs.lengths("name_norm"))
        return np.where(longer == 0, 1.0, 1 - pairs.of_texts(levenshteins_of, "name_norm") / np.maximum(longer, 1))

    def conflict() -> np.ndarray:
        a, b = pairs.counts("digits")
        return (a > 0) & (b > 0) & (shared("digits") == 0)

    def exact(column: str) -> np.ndarray:
        return pairs.equal(column) & (pairs.lengths(column)[0] > 0)

    return {
        "name_edit": edit, "name_jaccard": lambda: jaccard("core_tokens"), "name_containment": lambda: containment("core_tokens"),
        "address_jaccard": lambda: jaccard("address_tokens"), "address_containment": lambda: containment("address_tokens"), "digit_jaccard": lambda: jaccard("digits"), "digit_conflict": conflict,
        "country_equal": lambda: pairs.equal("country"), "name_exact": lambda: exact("name_norm"), "name_core_exact": lambda: exact("name_core"), "address_exact": lambda: exact("address_norm"),
        "address_missing": lambda: pairs.lengths("address_norm")[1] == 0, "name_length_ratio": lambda: length_ratio("name_norm"), "address_length_ratio": lambda: length_ratio("address_norm"),
        "same_target_source": lambda: np.where(pc.starts_with(pairs.held.rows.column("id"), "S2-").to_numpy(zero_copy_only=False)[pairs.t], 2.0, 3.0),
    }


def measured(voted: DataFrame, queries: DataFrame, targets: DataFrame, names: list[str], columns: list[str] = SET_COLUMNS, linked_by: str | None = None) -> DataFrame:
    """(q, t, votes, names) of all targets of voted, rows of blocking.voted with columns of the queries' records: features of set_features
    of these names, with nine digits. With linked_by, a column in which linked records are equal, hit is 1 for those and null for others."""

    def measure(pairs: cells.Pairs) -> tuple[None, dict]:
        able = set_measures(pairs)
        made = {n: np.round(able[n]().astype(np.float64), 9) for n in names}
        if linked_by:
            made["hit"] = np.where(pairs.equal(linked_by) & ~pairs.both_null(linked_by), 1, 0).astype(np.int32)
        return None, made

    kinds = dict.fromkeys(names, "double") | ({"hit": "int"} if linked_by else {})
    rows = cells.measured(voted, queries, targets, columns, measure, kinds)
    return rows.withColumn("hit", F.when(F.col("hit") == 1, 1)) if linked_by else rows


def string_features(q: str = "q_", t: str = "t_") -> Column:
    """A struct of the features that a pandas UDF computes, all in one pass."""
    return S.similarities_udf(*(F.col(f"{side}{name}") for name in ("name_norm", "name_core", "address_norm", "original_norm") for side in (q, t)))


def pair_features(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs(q, t, retrieval scores) with all features, from prepared records; the features are 32-bit floats."""
    rows = with_shared(with_records(pairs, queries, targets, [*SET_COLUMNS, "original_norm"])).withColumn("similar", string_features())
    made = set_features() | {n: F.col("similar")[n] for n in SIMILARITIES}
    rows = rows.select("q", "t", *RETRIEVAL, "retrieval_methods", *(e.cast("float").alias(n) for n, e in made.items()))
    return rows.withColumns({c: F.col(c).cast("float") for c in [*RETRIEVAL, "retrieval_methods"]})


def rank_features(rows: DataFrame) -> DataFrame:
    """Rank of and distance to the best of each retrieval score within a query, and the number of candidates; one exchange for all."""
    w = Window.partitionBy("q")
    ranks = {f"{c}_rank": F.rank().over(w.orderBy(F.desc(c))).cast("double") for c in RETRIEVAL}
    gaps = {f"{c}_from_best": F.max(c).over(w) - F.col(c) for c in RETRIEVAL}
    return rows.withColumns(ranks | gaps | {"candidate_count": F.count("*").over(w).cast("double")})


def blocking_names(rows: DataFrame) -> DataFrame:
    """The blocking path's own names of the retrieval scores."""
    names = {"char_name": "blocking_name", "char_address": "blocking_address", "bm25": "blocking_votes"}
    return rows.withColumnsRenamed({c: c.replace(a, b) for c in rows.columns for a, b in names.items() if c.startswith(a)})


def model_columns(rows: DataFrame) -> list[str]:
    """Numeric columns that a model may look at, in order."""
    return [c for c, kind in rows.dtypes if kind in ("float", "double", "int", "bigint") and c not in ("label", "probability", "fold")]
