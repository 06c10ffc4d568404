"""Exact top-k search by inner product, by a uniform threshold in three phases.

Vectors are split into lists by their positions; a list scores a query by its own positions only, and is read from a
column of its own. First, each list gives its best entries for each query; the scores of these few vectors are worked out,
and the k-th best is a cutoff that no answer lies under. A vector that reaches the cutoff has at least the cutoff's equal
share of it in some list, so in the second phase each list gives the entries that reach that share. In the third, entries
that all lists gave are summed, the scores of the others are resolved from the vectors, and the best k remain.

Equal vectors are one class from the start, which keeps its least ids only: a vector with very many copies is looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .numbers import numbered

K, LISTS = 5, 2
#: Queries are taken so many at a time, or fewer so that their numbers stay under BATCH_BYTES; scores of so many pairs are held at once.
BATCH, BATCH_BYTES, CELLS = 4096, 32 << 20, 2_000_000
NONE = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): floor(256 * x) of each component x. Rows without id, and vectors null or with components null or not finite, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * 256) < 2.0**62, F.floor(x.cast("double") * 256)).otherwise(F.raise_error(F.lit("a component of 2^54 or more"))).cast("long"))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", scaled.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of arrays as a matrix; shorter arrays count as zeros behind."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly, as 64-bit numbers: by doubles where all sums stay under 2^53."""
    bound = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if any(abs(x) >= 1 << 63 for x in exact.flat):
        raise OverflowError("an inner product has over 64 bits")
    return exact.astype(np.int64)


class Best:
    """The k best entries of each query so far, equal scores by tie."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.score, self.tie, self.cid = (np.empty(0, np.int64) for _ in range(4))
        self.least = np.full(n, NONE)

    def add(self, q: np.ndarray, score: np.ndarray, tie: np.ndarray, cid: np.ndarray) -> None:
        able = score >= self.least[q]
        q, score, tie, cid = (np.concatenate([old, new[able]]) for old, new in zip((self.q, self.score, self.tie, self.cid), (q, score, tie, cid), strict=True))
        order = np.lexsort((tie, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        last = place[place < self.k] == self.k - 1
        self.q, self.score, self.tie, self.cid = q[place < self.k], score[order], tie[order], cid[order]
        self.least[self.q[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (self.q, self.cid, self.score, self.tie))], names=["q", "cid", "score", "tie"])


FOUND = "q long, cid long, score long, tie long"


def list_best(classes: DataFrame, name: str, queries: np.ndarray, depth: int) -> DataFrame:
    """First phase: the depth best entries of one list for each query, in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), depth)
        for batch in batches:
            cid, tie = (batch.column(c).to_numpy() for c in ("cid", "tie"))
            part = matrix(batch.column(name), queries.shape[1])
            for at in range(0, len(part), step := max(1, CELLS // len(queries))):
                scores = products(queries, part[at : at + step])
                few = min(depth, scores.shape[1])
                cut = np.partition(scores, scores.shape[1] - few, axis=1)[:, -few]
                q, c = np.nonzero(scores >= np.maximum(cut, best.least)[:, None])
                best.add(q, scores[q, c], tie[at + c], cid[at + c])
        yield best.rows()

    return classes.select("cid", "tie", name).mapInArrow(tidy(run), FOUND)


def list_reports(classes: DataFrame, name: str, number: int, queries: np.ndarray, cutoff: np.ndarray, lists: int) -> DataFrame:
    """Second phase: (cid, list, qs, scores), of each class the queries for which its part reaches the cutoff's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = -((-cutoff) // lists)  # the least whole number that is no less than the share
        for batch in batches:
            cid, part = batch.column("cid").to_numpy(), matrix(batch.column(name), queries.shape[1])
            for at in range(0, len(part), step := max(1, CELLS // len(queries))):
                scores = products(part[at : at + step], queries)
                c, q = np.nonzero(scores >= share[None, :])
                full, starts = np.unique(c, return_index=True)
                ends = pa.array(np.append(starts, len(c)), pa.int32())
                packed = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (q.astype(np.int32), scores[c, q])]
                yield pa.RecordBatch.from_arrays([pa.array(cid[at + full]), pa.array(np.full(len(full), number, np.int32)), *packed], names=["cid", "list", "qs", "scores"])

    return classes.select("cid", name).mapInArrow(tidy(run), "cid long, list int, qs array<int>, scores array<long>")


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with that of b, exactly."""
    if max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 62:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(x * y for x, y in zip(r, s, strict=True)) for r, s in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def resolved(classes: DataFrame, reports: DataFrame, names: list[str], parts: list[np.ndarray], cutoff: np.ndarray, k: int, few: bool = False) -> DataFrame:
    """The k best of each query, in each task, of all that reports name. Reports are summed; scores that lack a list's part get it from the vector.

    few: reports are of a bounded number of classes, and are sent to where the vectors are.
    """
    n = len(cutoff)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k)
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                cid, tie, found = batch.column("cid").to_numpy(), batch.column("tie").to_numpy(), batch.column("reports")
                rows, each = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy()), found.flatten()
                sizes = each.field("qs").value_lengths().to_numpy()
                q, score = (each.field(c).flatten().to_numpy().astype(np.int64) for c in ("qs", "scores"))
                keys, at = np.unique(np.repeat(rows, sizes) * n + q, return_inverse=True)
                row, q = np.divmod(keys, n)
                total, known = np.zeros(len(keys), np.int64), np.zeros((len(keys), len(parts)), bool)
                np.add.at(total, at, score)
                known[at, np.repeat(each.field("list").to_numpy(), sizes)] = True
                for j, part in enumerate(parts):
                    lack, own = np.flatnonzero(~known[:, j]), matrix(batch.column(names[j]), part.shape[1])
                    for start in range(0, len(lack), step := max(1, CELLS // part.shape[1])):
                        some = lack[start : start + step]
                        total[some] += row_products(own[row[some]], part[q[some]])
                able = total >= cutoff[q]
                best.add(q[able], total[able], tie[row[able]], cid[row[able]])
        yield best.rows()

    by_class = reports.groupBy("cid").agg(F.collect_list(F.struct("list", "qs", "scores")).alias("reports"))  # one a list at most
    return classes.select("cid", "tie", *names).join(F.broadcast(by_class) if few else by_class, "cid").mapInArrow(tidy(run), FOUND)


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "tie"))).where(F.col("place") <= k).drop("place")


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def search(classes: DataFrame, names: list[str], parts: list[np.ndarray], k: int) -> DataFrame:
    """(q, cid, score, tie): the k best classes of each of a bounded number of queries, whose parts are the rows of parts."""
    n, lists = len(parts[0]), list(zip(range(len(names)), names, parts, strict=True))
    cutoff = np.full(n, NONE // 4)
    local = united([top(list_best(classes, name, part, k), k).groupBy("cid").agg(F.lit(j).alias("list"), F.collect_list(F.col("q").cast("int")).alias("qs"), F.collect_list("score").alias("scores")) for j, name, part in lists])
    known = top(resolved(classes, local, names, parts, cutoff, k, few=True), k)  # local has k entries a list and query at most
    for r in known.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect():  # a row a query
        cutoff[r.q] = r.least
    reports = united([list_reports(classes, name, j, part, cutoff, len(names)) for j, name, part in lists])
    return top(resolved(classes, reports, names, parts, cutoff, k), k)


def top_k(vectors: DataFrame, scratch: Scratch, every: int = 50, k: int = K, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row whose vec_id is divisible by every, with all other rows.

    Equal scores are ranked by vec_id; there are fewer than k where there are fewer other rows. vectors needs vec_id and
    embedding; other columns, of any name, are not looked at. Rows without id, and vectors null or with components null or
    not finite, take no part; a shorter vector counts as one with zeros behind, an empty one scores 0 with all. vec_id is a
    row's identity: of rows that share one the least vector counts, repeated rows count once. No rows, no result. Sums are
    exact; one of over 64 bits is an error. Queries are taken in batches of a bounded number of bytes, each against all rows.
    """
    rows = scratch.save(whole_numbers(vectors), "rows")
    length = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    lists = min(lists, length)
    width = -(-length // lists)
    names = [f"list{j}" for j in range(lists)]
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    placed, n = numbered(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), scratch, "placed", "cid")
    part = lambda j: F.slice(F.col("vec"), 1 + j * width, width).alias(names[j])
    classes = scratch.save(placed.select("cid", "ids", F.get("ids", F.lit(0)).alias("tie"), *map(part, range(lists))), "classes")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
    asking = scratch.save(asking.join(placed.select("vec", "cid"), "vec").select("query_id", "cid"), "asking")
    queries, n = numbered(classes.select("cid", *names).join(asking.select("cid").distinct(), "cid", "left_semi"), scratch, "queries", "q")
    together = max(1, min(BATCH, BATCH_BYTES // (8 * length)))
    found = scratch.spark.createDataFrame([], "query long, cid long, score long")
    for at in range(0, n, together):
        batch = queries.where((F.col("q") >= at) & (F.col("q") < at + together)).select("cid", *names).toArrow().combine_chunks()
        parts = [matrix(batch.column(name).chunk(0), width) for name in names]
        own = scratch.spark.createDataFrame([*enumerate(batch.column("cid").to_pylist())], "q long, query long")
        best = search(classes, names, parts, k + 1).join(F.broadcast(own), "q").select("query", "cid", "score")
        found = found.union(scratch.save(best, f"found-{at}"))
    members = found.join(classes.select("cid", "ids"), "cid").select(F.col("query").alias("q"), "score", F.explode("ids").alias("tie"))
    answers = top(members, k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), F.col("tie").alias("vec_id")))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each = asking.join(answers.withColumnRenamed("q", "cid"), "cid").select("query_id", F.posexplode(others).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.below")).alias("score"))
