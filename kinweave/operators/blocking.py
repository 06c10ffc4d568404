"""The blocking path: keys, capped blocks, votes, a pool of candidates, and a re-ranking by similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import postings
from ..functions import text as T
from ..functions.batch import common_of
from ..functions.similarity import ratio_udf
from . import cells

CAP, POOL, TOP = 256, 1500, 60
#: Columns that the re-ranking compares.
RANKED = ["name_core", "address_norm"]


def prepare(records: DataFrame) -> DataFrame:
    """records with all that is worked out once for each, before any join: normal forms, their words, digit runs and the country's key."""
    rows = records.withColumns({"name_norm": T.normalize_latin(F.col("business_name")), "address_norm": T.normalize_address(F.col("business_address")), "original_norm": T.normalize_text(F.col("business_name")), "country_key": T.country_key(F.col("country"))})
    rows = rows.withColumn("name_core", T.core_name(F.col("name_norm")))
    rows = rows.withColumns({"core_tokens": F.array_distinct(T.tokens(F.col("name_core"))), "address_tokens": F.array_distinct(T.tokens(F.col("address_norm"))), "digits": F.array_distinct(T.digit_runs(T.normalize_latin(F.col("business_address"))))})
    return rows.withColumn("combined_norm", F.concat_ws(" ", "name_core", "name_norm", "address_norm"))


def longest(items: Column, least: int, n: int) -> Column:
    """The n longest different items of at least so many characters, equal lengths by text."""
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter(items, lambda t: F.length(t) >= least)), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["t"])


def key_values(core: Column, address: Column) -> Column:
    """Values of the key families, with their prefixes."""
    nothing = F.array().cast("array<string>")
    tagged = lambda tag, items: F.transform(items, lambda t: F.concat(F.lit(f"{tag}:"), t))
    names = longest(T.tokens(core), 3, 4)
    compact = F.replace(core, F.lit(" "), F.lit(""))
    places = F.when(F.length(compact) >= 4, F.sequence(F.lit(1), F.length(compact) - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.array_sort(F.transform(F.array_distinct(F.transform(places, lambda i: F.substr(compact, i, F.lit(4)))), lambda g: F.struct(F.md5(g).alias("h"), g.alias("g"))))
    anchors = F.transform(F.slice(grams, 1, 3), lambda s: s["g"])
    words, runs = longest(T.tokens(address), 4, 5), T.digit_runs(address)
    numbers = longest(runs, 3, 2)
    near = F.array_sort(F.array_distinct(F.concat(F.slice(runs, 1, 1), F.slice(numbers, 1, 1))))
    pairs = F.flatten(F.transform(F.slice(words, 1, 3), lambda w: F.transform(near, lambda n: F.concat(w, F.lit(":"), n))))
    whole = F.filter(T.tokens(address), lambda t: t.rlike("^[0-9]+$"))
    door = F.when((F.size(whole) > 0) & (core != ""), F.array(F.concat(F.lit("d:"), F.substring(core, 1, 5), F.lit(":"), F.get(whole, F.lit(0))))).otherwise(nothing)
    named = F.concat(F.array(F.concat(F.lit("n:"), core), F.concat(F.lit("s:"), F.array_join(F.array_sort(T.tokens(core)), " "))), tagged("g", anchors))
    placed = F.concat(F.array(F.concat(F.lit("a:"), address)), tagged("at", words), tagged("an", numbers), tagged("ax", pairs))
    starts = F.transform(F.filter(names, lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 5))
    return F.array_distinct(F.concat(F.when(core != "", named).otherwise(nothing), F.when(address != "", placed).otherwise(nothing), tagged("t", names), tagged("p", starts), door))


def blocking_keys(prepared: DataFrame) -> DataFrame:
    """(entity_id, key), a row for each key; the country is part of it. Blank records have none."""
    values = prepared.select("entity_id", "country_key", F.explode(key_values(F.col("name_core"), F.col("address_norm"))).alias("value"))
    return values.select("entity_id", F.md5(F.concat("country_key", F.lit("|"), "value")).alias("key"))


def block_sizes(target_keys: DataFrame) -> DataFrame:
    return target_keys.groupBy("key").agg(F.count("*").alias("postings"))


def usable_blocks(target_keys: DataFrame, cap: int = CAP) -> DataFrame:
    """Postings of blocks of at most cap; broader blocks are left out whole, never cut."""
    return target_keys.join(block_sizes(target_keys).where(F.col("postings") <= cap).select("key"), "key", "left_semi")


def voted(query_keys: DataFrame, usable: DataFrame, most: int | None = None, beside: DataFrame | None = None, how: str = "left") -> DataFrame:
    """A row for each query that shares a key with usable postings: (q, codes, votes, others), arrays of its targets and of the keys shared with each.

    Of more than ``most`` targets the ones with most votes are there, equal ones by id. A key's postings, of which there are at most
    the cap, are packed and go to a query as one list; targets are rows again in each_vote. Columns of beside, a row for each query, are
    joined where the lists are (``how`` is "right" to keep queries without any), so that no targets are dealt again for them.
    """
    q, n = query_keys.select(F.col("entity_id").alias("q"), "key"), postings.number(F.col("entity_id"))
    lists = usable.groupBy("key").agg(F.collect_list(n).alias("ts"), F.collect_list(F.when(n.isNull(), F.col("entity_id"))).alias("rest"))
    met = q.join(lists.select("key", postings.packed_udf(F.col("ts")).alias("ts"), "rest"), "key")
    met = met.groupBy("q").agg(F.collect_list("ts").alias("ts"), F.flatten(F.collect_list("rest")).alias("rest"))
    more = [] if beside is None else [c for c in beside.columns if c != "q"]
    if beside is not None:
        met = met.join(beside, "q", how)
    full = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return met.select("q", *more, postings.voted_udf(full("ts", "binary"), full("rest", "string"), most).alias("v")).select("q", "v.codes", "v.votes", "v.others", *more)


def each_vote(rows: DataFrame) -> DataFrame:
    """(q, t, votes, more columns), a row for each target of rows(q, codes, votes, others, more columns)."""
    more = [c for c in rows.columns if c not in ("q", "codes", "votes", "others")]
    each = rows.select("q", "others", *more, F.explode(F.arrays_zip("codes", "votes")).alias("x"))
    code = F.col("x.codes")
    t = F.when(code < 0, F.get("others", -1 - code)).otherwise(postings.written(code))
    return each.select("q", t.alias("t"), F.col("x.votes").cast("long").alias("votes"), *more)


def among(rows: DataFrame, column: str) -> DataFrame:
    """(q, t) of the ids in a column of rows(q, codes, votes, others), of which there are few, that are among the targets; those are not made rows for it."""
    held = F.array_contains("codes", postings.number(F.col("t"))) | F.array_contains("others", F.col("t"))
    return rows.select("q", "codes", "others", F.explode(column).alias("t")).where(held).select("q", "t")


def sorted_ids(codes: str = "codes", others: str = "others") -> Column:
    """The ids of a row of voted, sorted."""
    return F.array_sort(F.concat(F.transform(F.filter(codes, lambda c: c >= 0), postings.written), others))


def count_votes(query_keys: DataFrame, usable: DataFrame, most: int | None = None, beside: DataFrame | None = None) -> DataFrame:
    """(q, t, votes, columns of beside): keys that queries share with usable postings; with ``most``, the pool of that size."""
    return each_vote(voted(query_keys, usable, most, beside))


def votes(query_keys: DataFrame, target_keys: DataFrame, cap: int = CAP) -> DataFrame:
    """(q, t, votes): shared keys in usable blocks."""
    return count_votes(query_keys, usable_blocks(target_keys, cap))


def top(rows: DataFrame, n: int, *order: Column, by: str = "q") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def pool(voted: DataFrame, n: int = POOL) -> DataFrame:
    return top(voted, n, F.desc("votes"), F.asc("t"))


def with_records(pairs: DataFrame, queries: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs(q, t) with columns of both records, named q_* and t_*; columns that pairs have already are not joined again."""
    for side, records in (("q", queries), ("t", targets)):
        if any(f"{side}_{c}" not in pairs.columns for c in columns):
            pairs = pairs.join(of_side(side, records, columns), side)
    return pairs


def of_side(side: str, records: DataFrame, columns: list[str]) -> DataFrame:
    return records.select(F.col("entity_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def rerank(pooled: DataFrame, queries: DataFrame, targets: DataFrame, n: int = TOP) -> DataFrame:
    """(q, t, char_name, char_address, bm25, retrieval_methods): the best n of each query by similarity; votes stand under bm25."""
    rows = with_records(pooled, queries, targets, RANKED)
    blank = lambda c: (F.col(f"q_{c}") == "") | (F.col(f"t_{c}") == "")
    similar = lambda c: F.when(blank(c), 0.0).otherwise(ratio_udf(F.col(f"q_{c}"), F.col(f"t_{c}")))
    rows = rows.withColumns({"char_name": similar("name_core"), "char_address": similar("address_norm")})
    name, address = F.col("char_name"), F.col("char_address")
    rows = rows.withColumn("rank", F.greatest(0.7 * name + 0.3 * address, 0.15 * name + 0.85 * address))
    return top(rows, n, F.desc("rank"), F.asc("t")).select("q", "t", "char_name", "char_address", F.col("votes").cast("double").alias("bm25"), F.lit(1).alias("retrieval_methods"))


def reranked(voted: DataFrame, queries: DataFrame, targets: DataFrame, n: int = TOP) -> DataFrame:
    """rerank of rows of voted with RANKED columns of the queries: pairs are compared in cells, and only a cell's best n of a query leave it."""

    def similar(pairs: cells.Pairs, column: str) -> np.ndarray:
        a, b = pairs.lengths(column)
        return np.where((a == 0) | (b == 0), 0.0, 2 * pairs.of_texts(common_of, column) / np.maximum(a + b, 1))

    def measure(pairs: cells.Pairs) -> tuple[np.ndarray, dict]:
        name, address = similar(pairs, "name_core"), similar(pairs, "address_norm")
        rank = np.maximum(0.7 * name + 0.3 * address, 0.15 * name + 0.85 * address)
        return cells.best_of_rows(pairs.q, (-rank, pairs.held.order[pairs.t]), n), {"char_name": name, "char_address": address, "rank": rank}

    rows = cells.measured(voted, queries, targets, RANKED, measure, dict.fromkeys(("char_name", "char_address", "rank"), "double"))
    return top(rows, n, F.desc("rank"), F.asc("t")).select("q", "t", "char_name", "char_address", F.col("votes").cast("double").alias("bm25"), F.lit(1).alias("retrieval_methods"))


def retrieve(queries: DataFrame, targets: DataFrame, cap: int = CAP, pool_size: int = POOL, n: int = TOP) -> DataFrame:
    """Candidates of prepared queries among prepared targets."""
    return reranked(voted(blocking_keys(queries), usable_blocks(blocking_keys(targets), cap), pool_size, of_side("q", queries, RANKED)), queries, targets, n)
