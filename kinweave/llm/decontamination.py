"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's k-grams of words are hashed, and each run of 13 words is stood for by the least hash of its k-grams. Equal runs have
equal least hashes, so the join of both sides' selected hashes misses no shared run. A document's runs whose selected hash was
found are then compared word for word, which extends a hit to all that is shared. Items of fewer words are one run each and are
looked up by the hashes of all runs of their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

WINDOW, GRAM = 13, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever parts words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of at most so many rows (of two numbers, or of one run's text) is sent to all executors; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def shifted(a: Column, b: Column, by: int, f) -> Column:
    """f(a[i], b[i + by]); places without both hold leftovers, which grams() cuts off."""
    return F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b), F.lit(1))), f)


def upto(c: Column, n: Column, length: int) -> Column:
    return F.slice(c, 1, F.greatest(n - length + 1, F.lit(0)))


def doubled(rows: DataFrame, column: str, length: int, f) -> tuple[DataFrame, str]:
    """rows with a column that combines each run of so many places of ``column``, and its name.

    Each doubling is a column of its own: an expression that holds another one twice would work it out twice.
    """
    k, name = 1, column
    while k < length:
        step = min(k, length - k)
        k, last, name = k + step, name, f"{column}_{k + step}"
        if name not in rows.columns:  # another length may have made it
            rows = rows.withColumn(name, shifted(F.col(last), F.col(last), step, f))
    return rows, name


def selected(rows: DataFrame, length: int, winnow: bool) -> DataFrame:
    """rows(w, n) with ``fp``: for each run of so many words, the hash that stands for it; empty for fewer words."""
    rows = rows if "h" in rows.columns else rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    rows, name = doubled(rows, "h", GRAM if winnow else length, lambda a, b: F.xxhash64(a, b))
    if winnow:
        rows = rows.withColumn("g", upto(F.col(name), F.col("n"), GRAM))
        rows, name = doubled(rows, "g", length - GRAM + 1, lambda a, b: F.least(a, b))
    return rows.withColumn("fp", upto(F.col(name), F.col("n"), length))


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast, if it is shown to have few rows and bytes."""
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """All rows and columns of docs, with n_words, n_hit, n_items, items (sorted array of item ids as text) and contaminated.

    A null text has no words. An item without words has no window and never occurs; a null item id is the text ''. Repeated
    rows are judged alike, and very long texts whole. Columns of docs with the names of results are replaced, ``__rk`` is
    reserved, and all others come back. An empty table gives an empty one; without items nothing is hit.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated").withColumn("__rk", row_key())
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    length = F.least("n", F.lit(WINDOW))
    windows = scratch.save(
        items.select("item", length.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda i: F.array_join(F.slice("w", i, length), " "))).alias("run")).distinct(), "windows"
    )
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())  # 13 values at most
    runs = windows.select("run", "len").distinct().select("run", "len", F.split("run", " ").alias("w"), F.col("len").alias("n"))
    texts = docs.select(F.col("__rk").alias("rk"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))

    plain = docs.withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    if not lengths:
        none = F.array().cast("array<string>")
        return plain.drop("__rk").withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": none, "contaminated": F.lit(False)})
    marks = [selected(runs.where(F.col("len") == k), k, k == WINDOW).select("len", F.explode("fp").alias("fp")) for k in lengths]
    wanted = small(scratch.save(reduce(DataFrame.unionAll, marks).distinct(), "wanted"))
    here = texts  # all lengths in one pass over the texts
    for k in lengths:
        here = selected(here, k, k == WINDOW).withColumnRenamed("fp", f"fp{k}")
    named = lambda k: F.transform(F.array_distinct(f"fp{k}"), lambda x: F.struct(F.lit(k).alias("len"), x.alias("fp")))
    each = F.concat(*map(named, lengths))
    hits = here.select("rk", F.inline(each)).join(wanted, ["len", "fp"]).groupBy("rk", "len").agg(F.collect_set("fp").alias("hits"))
    hits = scratch.save(hits.select("rk", "len", "hits"), "hits")

    # only documents with a hit are looked at again, and in them only the runs that a hit stands for
    some = small(hits.select("rk").distinct())
    again = docs.select(F.col("__rk").alias("rk"), "text").join(some, "rk", "left_semi").dropDuplicates(["rk"]).join(small(hits), "rk").select("rk", "len", "hits", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    places = []
    for k in lengths:
        at = selected(again.where(F.col("len") == k), k, k == WINDOW)
        start = F.filter(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_contains("hits", F.element_at("fp", i)))
        run = F.transform(start, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("w", i, k), " ").alias("run")))
        places.append(at.where(F.col("n") >= k).select("rk", F.lit(k).alias("len"), F.inline(run)))
    matched = scratch.save(reduce(DataFrame.unionAll, places).join(small(windows.select("run").distinct()), "run", "left_semi"), "matched")
    # runs of one document, by start: what each adds to the words covered so far
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n")),
        lambda s: s["n"],
    )
    hit = matched.groupBy("rk").agg(covered.alias("n_hit"))
    names = matched.select("rk", "run").distinct().join(small(windows.select("run", "item")), "run").groupBy("rk").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = scratch.save(hit.join(names, "rk"), "result")
    out = plain.join(small(result).withColumnRenamed("rk", "__rk"), "__rk", "left").drop("__rk")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})
