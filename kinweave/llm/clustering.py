"""Clusters of classes whose sets of shingles are alike, from buckets of candidates.

Buckets are not expanded into pairs: members are first compared with their bucket's leader, components are formed, and only
members that lie in different components are compared further, in blocks of a bounded size and by bounds that need no text.
Links within a component add nothing to it, so none that matters is lost. Candidates are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .common import Scratch, tidy, with_few
from .components import components
from .shingles import shingle

#: Characters of candidate pairs that a worker compares at a time.
PAIR_CHARS = 1_000_000
#: Bits in a map of a set; larger sets fill it, and the bound it gives then says less.
BITS = 1024
#: Stands for no key; pairs whose keys are compared at a time.
LAST, TOGETHER = np.iinfo(np.int64).max, 2000
#: Members of a bucket are dealt to blocks of about so many, and two blocks at a time are compared.
BLOCK = 512


def confirm(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Those of pairs(a, b) whose sets meet the share, exactly; texts(sh, text)."""
    up, down = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            at = 0
            for part in chunks(right, PAIR_CHARS):
                one = left[at : at + len(part)]
                distinct = {t: i for i, t in enumerate(dict.fromkeys([*one, *part]))}
                got = shingle(list(distinct), width)
                keep = np.zeros(len(part), bool)
                for i, (x, y) in enumerate(zip(one, part, strict=True)):
                    x, y = got.of(distinct[x]), got.of(distinct[y])
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = common > 0 and down * common >= up * (len(x) + len(y) - common)
                yield batch.slice(at, len(part)).select(["a", "b"]).filter(pa.array(keep))
                at += len(part)

    a, b = (texts.select(F.col("sh").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def lone_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(sh, lone): how many shingles of each of texts(sh, text) no other one has; texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist(), PAIR_CHARS):
                got = shingle(part, width)
                own = batch.column("sh").to_numpy()[at : at + len(part)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, np.diff(got.bounds))), pa.array(got.hashes.view(np.int64))], names=["sh", "h"])
                at += len(part)

    rows = texts.mapInArrow(tidy(run), "sh long, h long")
    return rows.groupBy("h").agg(F.count("*").alias("times"), F.min("sh").alias("sh")).where("times = 1").groupBy("sh").agg(F.count("*").alias("lone"))


def bitmaps(texts: DataFrame, width: int) -> DataFrame:
    """(sh, bits): of each of texts(sh, text) a map with a bit for each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist(), PAIR_CHARS):
                got = shingle(part, width)
                bits = np.zeros((len(part), BITS), bool)
                bits[np.repeat(np.arange(len(part)), np.diff(got.bounds)), (got.hashes % np.uint64(BITS)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([batch.column("sh").slice(at, len(part)), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["sh", "bits"])
                at += len(part)

    return texts.mapInArrow(tidy(run), "sh long, bits binary")


def bucketed(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, sh, n, leader) of keys(key, sh, n) that several classes have; leader is the least one."""
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("sh").alias("leader")).where("size > 1").select("key", "leader")
    return with_few(keys, scratch.save(shared, "shared"), "key")


def able_pairs(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b), a < b: pairs of different roots that share a key and that the bounds allow, from rows(key, sh, root, n, m, bits, keys).

    A key's members are dealt to blocks by hash; each pair of blocks is a group of at most some BLOCK * 2 rows, so that a large
    bucket is shared out over many tasks and none holds it whole. A pair comes from the least of the keys that it shares only.
    """
    up, down = share
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("sh", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select("key", "i", "j", "block", "sh", "root", "n", "m", "bits", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(group: pa.Table) -> pa.RecordBatch:
        block, sh, root, n, m = (group.column(c).to_numpy() for c in ("block", "sh", "root", "n", "m"))
        bits = np.unpackbits(np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(sh), BITS // 8), axis=1).astype(np.float32)
        x = np.nonzero(block == group.column("i")[0].as_py())[0]
        y = x if group.column("i")[0] == group.column("j")[0] else np.nonzero(block == group.column("j")[0].as_py())[0]
        own = bits.sum(1)
        both = bits[x] @ bits[y].T  # a bit that one map has and the other has not is a shingle that is not shared
        shared = np.minimum(np.minimum(m[x][:, None], m[y]), np.minimum((n - own)[x][:, None], (n - own)[y]) + both)
        fit = (down * shared >= up * (n[x][:, None] + n[y] - shared)) & (root[x][:, None] != root[y])
        k, l = np.nonzero(np.triu(fit, 1) if y is x else fit)
        k, l = x[k], y[l]
        own = group.column("keys").to_pylist()
        keys = np.full((len(own), max(map(len, own))), LAST)
        for i, row in enumerate(own):
            keys[i, : len(row)] = row
        here, once = group.column("key")[0].as_py(), np.ones(len(k), bool)
        for at in range(0, len(k), TOGETHER):
            p, q = keys[k[at : at + TOGETHER]], keys[l[at : at + TOGETHER]]
            both = (p[:, :, None] == q[:, None, :]).any(2) & (p != LAST)
            once[at : at + TOGETHER] = np.where(both, p, LAST).min(1, initial=LAST) == here
        a, b = sh[k[once]], sh[l[once]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            places = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.nonzero((places[:, 1:] != places[:, :-1]).any(0))[0] + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[0].column(c)[0] != batch.column(c)[a] for c in ("key", "i", "j")):
                    yield pairs(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def cluster(
    members: DataFrame,
    scratch: Scratch,
    width: int,
    share: tuple[int, int],
    fetch: Callable[[DataFrame], DataFrame],
    screen: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) that connect all of members(key, sh, n, leader) that can be linked within their buckets, and (node, root) of their components.

    n is the size of a class's set; fetch gives (sh, text) of wanted (sh); screen drops pairs that can't be links.

    Shingles that one class alone has are in no intersection: with m shingles that others have too, at most m are shared. In
    buckets that hold several components all members are compared with the one that has fewest of its own, and then those left
    apart with each other by that bound and by bitmaps: each bit that one bitmap has and the other has not is a shingle that is
    not shared either.
    """
    up, down = share

    def linked(pairs: DataFrame, texts: DataFrame | None, name: str) -> DataFrame:
        pairs = scratch.save(screen(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), f"pairs-{name}")
        own = scratch.save(fetch(pairs.select(F.explode(F.array("a", "b")).alias("sh")).distinct()), f"texts-{name}") if texts is None else texts
        found = scratch.save(confirm(pairs, own, width, share), f"links-{name}")
        scratch.drop(f"pairs-{name}", *[f"texts-{name}"] * (texts is None))
        return found

    def apart(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """rows(key, sh, ...) of buckets with several roots, with them."""
        placed = rows.join(roots.withColumnRenamed("node", "sh"), "sh", "left").withColumn("root", F.coalesce("root", "sh"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return scratch.save(placed.join(mixed, "key"), name)

    def joined(roots: DataFrame, more: DataFrame, name: str) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, name)

    links = linked(members.where("sh <> leader").select(F.col("leader").alias("a"), F.col("sh").alias("b")), None, "leader")
    roots = components(links, scratch, "roots-leader")
    rows = apart(members.select("key", "sh"), roots, "apart")
    if rows.isEmpty():
        return links, roots
    texts = scratch.save(fetch(rows.select("sh").distinct()), "texts-apart")
    sizes = members.select("sh", "n").distinct().join(lone_shingles(texts, width), "sh", "left").select("sh", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("m"))
    facts = scratch.save(sizes.where(down * F.col("m") >= up * F.col("n")).join(bitmaps(texts, width), "sh"), "facts")
    rows = scratch.save(rows.join(facts.select("sh", "n", "m"), "sh"), "able")
    hubs = rows.groupBy("key").agg(F.max(F.struct(F.col("m") / F.col("n"), "sh", "root")).alias("hub")).select("key", F.col("hub.sh").alias("a"), F.col("hub.root").alias("ra"))
    more = linked(rows.join(hubs, "key").where("root <> ra").select("a", F.col("sh").alias("b")), texts, "hub")
    links, roots = links.union(more), joined(roots, more, "roots-hub")
    rows = apart(rows.select("key", "sh"), roots, "rest")
    if not rows.isEmpty():
        keys = rows.groupBy("sh").agg(F.collect_set("key").alias("keys"))
        more = linked(able_pairs(rows.join(facts.join(keys, "sh"), "sh"), share), texts, "rest")
        links, roots = links.union(more), joined(roots, more, "roots-rest")
    scratch.drop("apart", "able", "rest", "texts-apart", "facts")
    return links, roots
