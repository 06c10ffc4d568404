"""Connected components of links, by large-star and small-star steps; nothing but a number a step comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Links that a worker contracts at a time.
TOGETHER = 1_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label[x] == label[y]).all():
            rest = np.nonzero(label != np.arange(len(nodes)))[0]
            return nodes[rest], nodes[label[rest]]


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), a > b, with the same components: each task contracts its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def contract() -> pa.RecordBatch:
            a, b = contracted(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab"))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= TOGETHER:
                yield contract()
                held, size = [], 0
        if size:
            yield contract()

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b. Large: each node's larger neighbours are tied to its least one; small: the smaller ones and itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def done(edges: DataFrame) -> bool:
    """Each node is tied to one root, and no root is tied to another: counts per node, summed before they are dealt out."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("ties")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("ties").alias("ties"))
    return each.where("tied > 1 OR tied = 1 AND ties = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of all nodes of edges(a, b) but the roots, which are the least of their components.

    Contracted edges are put together in tasks of about TOGETHER and contracted again, without a shuffle; what doesn't become
    fewer by that is joined by the star steps. At most TOGETHER edges are finished in one task.
    """
    state, step = scratch.save(forest(edges), f"{name}-0"), 0
    count, before, packed = state.count(), None, False
    while not (packed and before <= TOGETHER) and not (packed and count > 0.9 * before and done(state)):
        packs = not packed or count <= 0.9 * before or count <= TOGETHER
        state = state.coalesce(-(-count // TOGETHER) or 1) if packs else stars(stars(state, True), False)
        step += 1
        state = scratch.save(forest(state), f"{name}-{step}", release=not packs)
        scratch.drop(f"{name}-{step - 1}")
        count, before, packed = state.count(), count, packs
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
