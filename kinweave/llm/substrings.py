"""Removal of byte strings of a given length that start in more than one place, by suffix arrays.

Texts are too many for one suffix array, so their strings are dealt out first. Each string of L bytes belongs to the least
k-gram in it (the leftmost of equal ones): equal strings have equal k-grams at equal places. Runs of neighbouring strings that
belong to one k-gram form a segment, and segments of one k-gram meet in one group. Groups of a single place hold nothing
repeated and are dropped; equal segments are counted and kept once, with their count.

The segments of many groups are then laid end to end, and of their Burrows-Wheeler transform intervals are extended backward,
breadth first: the interval of a string w goes to those of cw, and a right end that is first met at length l ends a common
prefix of l bytes. Stopping after L - 1, the ends not met lie within strings that agree in L bytes or more: those classes are
the repeated strings.

A group of more than ``GROUP_SEGMENTS`` different segments is dealt out again, string by string, so that no task's share grows
with a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, tidy
from .shingles import mix, range_hash

LENGTH, GRAM = 200, 64
#: Bytes of text that are hashed at a time; also the most that a slice of one long text holds.
SLICE = 1 << 20
#: Bytes of segments under one suffix array, beyond the group that is under way.
BATCH = 1 << 19
GROUP_SEGMENTS = 1000
C1, C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place, by doubling; gram is a power of two. Shorter by gram - 1."""
    h = (data.astype(np.uint64) + np.uint64(1)) * C1
    k = 1
    while k < gram:
        h = h[:-k] * C1 + ((h[k:] >> np.uint64(29)) ^ h[k:]) * C2
        k *= 2
    return mix(h)


def segments(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts of the given sizes, laid end to end: text, first string, number of strings, place of the k-gram, its hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, gram)
    value = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost is least
    width, k = length - gram + 1, 1
    while 2 * k <= width:
        value = np.minimum(value[:-k], value[k:])
        k *= 2
    if k < width:
        value = np.minimum(value[: len(value) - (width - k)], value[width - k :])
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - sizes, counts)
    at = (value[place] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    start = np.nonzero(first)[0]
    many = np.diff(np.append(start, len(at)))
    return text[start], place[start], many, at[start], h[at[start]]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, seg, rk, place, many): segments of all texts. place is the first string's first byte, many the number of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[int], origins: list[int], parts: list[bytes]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(parts), np.uint8)
            sizes = np.array([len(p) for p in parts], np.int64)
            text, place, many, at, key = segments(data, sizes, length, gram)
            own = range_hash(data, place, place + many + length - 1) ^ (at - place).astype(np.uint64) * C1
            first = (np.array(origins, np.int64) - (np.cumsum(sizes) - sizes))[text] + place
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mix(own).view(np.int64)), pa.array(np.array(keys, np.int64)[text]), pa.array(first), pa.array(many.astype(np.int32))], names=["key", "seg", "rk", "place", "many"])

        for batch in batches:
            keys, origins, parts, total = [], [], [], 0
            for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                # a slice ends with the strings that start in it; the next one starts with the string after them
                for at in range(0, max(len(data) - length + 1, 0), SLICE):
                    part = data[at : at + SLICE + length - 1]
                    if parts and total + len(part) > SLICE + length:
                        yield out(keys, origins, parts)
                        keys, origins, parts, total = [], [], [], 0
                    keys.append(rk)
                    origins.append(at)
                    parts.append(part)
                    total += len(part)
            if parts:
                yield out(keys, origins, parts)

    return docs.select(row_key().alias("rk"), "text").where(F.octet_length("text") >= length).mapInArrow(tidy(run), "key long, seg long, rk long, place long, many int")


def suffix_array(text: np.ndarray, owner: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Order of suffixes. text: 0 ends a segment, other values are bytes + 1; owner: number of the segment, rest: places to its end."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.int64)
    for k in range(7):  # nothing counts after an end
        packed = packed << 9 | np.where(rest >= k, padded[k : n + k], 0)
    order = np.argsort(packed, kind="stable")
    key, k = packed, 7
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        # a suffix that ends within k is told from its equals by its segment
        after = np.where(rest < k, owner, n + rank[np.minimum(np.arange(n) + k, n - 1)])
        key = rank * (2 * n) + after
        order = np.argsort(key, kind="stable")
        k *= 2


def interval_ends(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Where, in suffix order, a common prefix of less than length bytes ends: True at i if suffixes i - 1 and i differ sooner."""
    n = len(text)
    bwt = text[order - 1]
    # LF: where the suffix one byte longer stands
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    ended = np.zeros(n + 1, bool)
    ended[0] = ended[n] = True
    stops = int((text == 0).sum())
    ended[: stops + 1] = True  # ends of segments are all different
    low, high = np.array([0]), np.array([n])  # of the empty string
    for depth in range(length):
        # intervals [low, high) of strings of one length; those of one byte more, by the byte before
        width = high - low
        lone = width == 1
        at = low[lone]
        at = at[bwt[at] > 0]
        new_low = [step[at]]
        new_high = [step[at] + 1]
        low, width = low[~lone], width[~lone]
        if len(low):
            which = np.repeat(np.arange(len(low)), width)
            place = np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
            kept = bwt[place] > 0
            which, place = which[kept], place[kept]
        if len(low) and len(which):
            to = np.sort(step[place] + which * (n + 1))  # neighbours that come from one interval by one byte stay neighbours
            which, to = np.divmod(to, n + 1)
            byte = text[order[to]]
            first = np.ones(len(to), bool)
            first[1:] = (which[1:] != which[:-1]) | (byte[1:] != byte[:-1])
            begin = np.nonzero(first)[0]
            new_low.append(to[begin])
            new_high.append(to[np.append(begin[1:], len(to)) - 1] + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~ended[high]
        low, high = low[fresh], high[fresh]
        ended[high] = True
        if depth == 0:  # the ends of segments are strings of one byte too
            low, high = np.concatenate([low, np.arange(stops)]), np.concatenate([high, np.arange(1, stops + 1)])
        if not len(low):
            break
    return ended


def repeated_strings(parts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, the places of strings of that length that stand in other segments too, or in a segment counted more than once."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 1
    stop = np.cumsum(sizes) - 1
    text[stop] = 0
    owner = np.repeat(np.arange(len(parts)), sizes)
    rest = stop[owner] - np.arange(len(text))
    order = suffix_array(text, owner, rest)
    ended = interval_ends(order, text, length)[:-1]
    whole = rest[order] >= length
    group = np.cumsum(ended) - 1
    total = np.bincount(group, np.where(whole, weights[owner[order]], 0))
    found = np.sort(order[whole & (total[group] > 1)])
    bounds = np.searchsorted(owner[found], np.arange(len(parts) + 1))
    return [found[a:b] - (stop[i] + 1 - sizes[i]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that strings at these places cover, as (from, to), from first to last."""
    if not len(places):
        return []
    cut = np.nonzero(np.diff(places) > length)[0] + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])
    return [(int(places[a]), int(places[b - 1]) + length) for a, b in zip(begin, end, strict=True)]


SPANS = "spans array<struct<start: bigint, stop: bigint>>"
SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rk, spans): byte ranges of each text (by its row key) that repeated strings cover; they may overlap. Texts without any are left out."""
    held = scratch.save(anchors(docs, length, gram), "anchors")
    # both sides of the join are read from files: Spark can then split the partition of a frequent key
    shared = scratch.save(held.groupBy("key").agg(F.count("*").alias("places")).where("places > 1").select("key"), "keys")
    held = scratch.save(held.join(shared, "key"), "shared")
    scratch.drop("anchors")
    # equal segments once, with their count and one of their places
    kinds = held.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("rk", "place", "many")).alias("one"))
    kinds = scratch.save(kinds.select("key", "seg", "n", "one.*"), "kinds")
    groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
    several = kinds.join(groups.where("kinds > 1"), "key")
    cuts = several.groupBy("rk").agg(F.collect_list(F.struct("key", "seg", "n", "place", "many", "kinds")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                columns = {k: [w[k] for w in wanted] for k in ("key", "seg", "n", "kinds")}
                parts = [data[w["place"] : w["place"] + w["many"] + length - 1] for w in wanted]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns.values()), pa.array(parts, pa.binary())], names=[*columns, "part"])

    texts = docs.select(row_key().alias("rk"), "text").join(cuts, "rk").dropDuplicates(["rk"]).select("text", "cuts")
    parts = scratch.save(texts.mapInArrow(tidy(cut), "key long, seg long, n long, kinds long, part binary"), "parts")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key."""
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = repeated_strings([r[3] for r in rows], np.array([r[2] for r in rows]), length)
            full = [(r[0], r[1], [{"start": a, "stop": b} for a, b in runs(f, length)]) for r, f in zip(rows, found, strict=True) if len(f)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in full], pa.int64()), pa.array([r[1] for r in full], pa.int64()), pa.array([r[2] for r in full], SPANS_TYPE)], names=["key", "seg", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "part")), strict=True):
                if size >= BATCH and row[0] != rows[-1][0]:
                    yield out()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) + 1
        if rows:
            yield out()

    usual = parts.where(F.col("kinds") <= GROUP_SEGMENTS).select("key", "seg", "n", "part")
    spans = usual.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(expand), f"key long, seg long, {SPANS}")
    huge = parts.where(F.col("kinds") > GROUP_SEGMENTS)
    # groups of one kind of segment, and strings of groups dealt out again: a count is all that is left to see
    same = kinds.join(groups.where("kinds = 1"), "key").where("n > 1").select("key", "seg", F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("many") + length - 1).cast("long").alias("stop"))).alias("spans"))
    found = spans.union(same)
    if not huge.isEmpty():
        starts = F.sequence(F.lit(1), F.octet_length("part") - length + 1)
        strings = huge.select("key", "seg", "n", "part", F.explode(starts).alias("at")).select("key", "seg", "n", "at", F.expr(f"substring(part, at, {length})").alias("string"))
        # strings of a hash of their own are alone; all others are counted by their bytes
        strings = strings.withColumn("hash", F.xxhash64("string"))
        able = strings.join(strings.groupBy("hash").agg(F.sum("n").alias("all")).where("all > 1").select("hash"), "hash")
        often = able.groupBy("string").agg(F.sum("n").alias("all")).where("all > 1").select("string")
        places = able.join(often, "string").select("key", "seg", (F.col("at") - 1).cast("long").alias("start"))
        whole = places.groupBy("key", "seg").agg(F.collect_list(F.struct("start", (F.col("start") + length).alias("stop"))).alias("spans"))
        found = found.union(whole)
    found = scratch.save(found, "found")
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("place")).alias("start"), (s["stop"] + F.col("place")).alias("stop")))
    return held.select("key", "seg", "rk", "place").join(found, ["key", "seg"]).groupBy("rk").agg(F.flatten(F.collect_set(moved)).alias("spans"))


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (binary: what is left), removed (maximal ranges start, stop of removed bytes) for each row of docs(doc_id, text).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, its own text included.
    Strings are judged on the input, and texts in UTF-8. A null text is empty; a text shorter than ``length`` is kept. Rows that
    are alike repeat each other, so all of theirs goes if it is long enough. Very long texts are cut into segments, which no
    string is lost by. An empty table gives an empty one, and other columns, of any name, are not looked at.
    """
    spans = scratch.save(repeated_spans(docs, scratch, length, gram), "spans")
    rows = docs.select("doc_id", "text", row_key().alias("rk")).join(spans, "rk", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sizes, kept, removed = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    joined: list[list[int]] = []
                    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                        if joined and start <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], stop)
                        else:
                            joined.append([start, stop])
                    sizes.append(len(data))
                    ends = [0, *(x for j in joined for x in j), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                    removed.append([{"start": a, "stop": b} for a, b in joined])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, SPANS_TYPE)], names=["doc_id", "n_bytes", "kept", "removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, kept binary, removed array<struct<start: bigint, stop: bigint>>")
