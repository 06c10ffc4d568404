"""MinHash near-duplicates by a multi-index Hamming join.

A set of shingles has a signature of K symbols of b bits, the least values of K hash functions. The signature is split into
chunks of four symbols; with K / 4 chunks and a distance of less than 2 K / 4 symbols, some chunk has one error at most
(pigeonhole), so the four keys that leave out one symbol of each chunk bring all such pairs into a bucket: nothing under the
distance is missed. Candidates are confirmed on their full sets.

Equal sets are one class from the start; classes that meet in buckets are clustered without expanding buckets into pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .clustering import bucketed, cluster
from .common import Scratch, row_key, tidy, with_few
from .shingles import mix, shingle

CHUNK = 4
CHUNK_CHARS = 1_000_000


def hash_constants(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 63, symbols, dtype=np.uint64), rng.integers(0, 1 << 62, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(got, symbols: int) -> np.ndarray:
    """16-bit symbols, a row for each text."""
    out = np.empty((len(got.bounds) - 1, symbols), np.uint16)
    for k, (a, b) in enumerate(zip(*hash_constants(symbols), strict=True)):
        out[:, k] = mix(got.reduce(np.minimum, (got.hashes ^ a) * b, 0)) >> np.uint64(48)
    return out


def profile(docs: DataFrame, width: int, symbols: int) -> DataFrame:
    """doc_id, rk, sh (hash of the set), n (its size), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist(), CHUNK_CHARS):
                got = shingle(part, width)
                sig = signatures(got, symbols)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), batch.column("rk").slice(at, len(part)), pa.array(got.set_hash()), pa.array(np.diff(got.bounds)), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "rk", "sh", "n", "sig"],
                )
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("rk"), "text").mapInArrow(tidy(run), "doc_id long, rk long, sh long, n long, sig binary")


def index_keys(classes: DataFrame, symbols: int) -> DataFrame:
    """(key, sh, n): for each chunk, its other symbols with one left out."""
    places = [(c, m) for c in range(symbols // CHUNK) for m in range(CHUNK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(batch), symbols).astype(np.int64)
            for c, m in places:
                a, b, d = (sig[:, c * CHUNK + x] for x in range(CHUNK) if x != m)
                key = np.int64(c * CHUNK + m) << 48 | a << 32 | b << 16 | d
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("sh"), batch.column("n")], names=["key", "sh", "n"])

    return classes.select("sh", "n", "sig").mapInArrow(tidy(run), "key long, sh long, n long")


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int, share: tuple[int, int], symbols: int = 32) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, kept, n_links, root of docs(doc_id, text); rk is the row's key.

    Two rows are linked if down * |intersection| >= up * |union| for share = (up, down). component_id is the least doc_id that
    links lead to, its own included; kept says that it is the row's own. n_links counts confirmed links of the row's class to
    others, as far as they were needed. root is the component's own key, null for rows without shingles. Null and empty texts have no shingles and are
    linked with nothing. Repeated rows are of one class; of ids, nulls are not counted as least, and a row without one has its
    component's id, or null. Very long texts are compared whole. An empty table gives an empty one, and other columns, of any
    name, are not looked at.
    """
    up, down = share
    rows = scratch.save(profile(docs, width, symbols), "rows")
    classes = scratch.save(rows.where("n > 0").groupBy("sh").agg(F.min("doc_id").alias("id"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    keys = index_keys(classes, symbols)
    members = scratch.save(bucketed(keys, scratch), "members")

    facts = classes.select("sh", "n", "sig")
    distance = 2 * (symbols // CHUNK) - 1

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, symbols) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= distance))

    def screen(pairs: DataFrame) -> DataFrame:
        """Pairs that can meet the share by their sizes and are under the distance."""
        a, b = (facts.select(F.col("sh").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
        both = pairs.join(b, "b").join(a, "a").where(down * F.least("na", "nb") >= up * F.greatest("na", "nb"))
        return both.select("a", "b", "sa", "sb").mapInArrow(tidy(near), "a long, b long")

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = scratch.save(wanted.join(classes.select("sh", "rk"), "sh"), f"wanted-{uuid.uuid4().hex}")
        return with_few(docs.select(row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text")), wanted, "rk").select("sh", "text").dropDuplicates(["sh"])

    links, roots = cluster(members, scratch, width, share, fetch, screen)
    scratch.drop("members")
    placed = classes.select("sh", "id").join(roots.withColumnRenamed("node", "sh"), "sh", "left").withColumn("root", F.coalesce("root", "sh"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    counts = links.select(F.explode(F.array("a", "b")).alias("sh")).groupBy("sh").agg(F.count("*").alias("n_links"))
    found = scratch.save(placed.join(least, "root").join(counts, "sh", "left").select("sh", "root", "component_id", "n_links"), "found")
    scratch.drop("classes", "shared", "links-leader", "links-hub", "links-rest")
    out = rows.join(found, "sh", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")
