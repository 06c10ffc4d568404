"""Importance resampling towards a target distribution, over hashed runs of words.

The features of a text are its runs of 1 to ``width`` words; each falls into a bucket, its CRC modulo the number of
buckets. Every text is read once: its buckets are written as a packed stream of 16-bit numbers, many documents in a row,
with the documents' offsets. Counts come from sorting each stream and taking the lengths of its runs; the gains of the
buckets are then gathered along the same streams and added up between the offsets. A Gumbel number from a digest of the
id is added, and the highest scores are drawn, which is sampling without replacement by importance.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, tidy
from .numbers import numbered

BUCKETS, WIDTH, SEED, LEAST_WORDS, PERCENT = 10_000, 2, 7, 20, 25
#: A row of streams holds so many features, or one document that has more; so many bytes of a text are split into words at a time.
TOGETHER, PIECE = 500_000, 1 << 20

#: What bytes become before a text is split at blanks: A-Z are lower-cased; digits, letters and bytes beyond ASCII stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

STREAMS = "ids array<long>, keys array<long>, words array<long>, offsets array<long>, stream binary"
SCORED = "doc_id long, rk long, n_features long, n_words long, weight long, score long"


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of data, a list for each piece of about PIECE bytes."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        if words := data[at:end].split():
            yield words
        at = end


def buckets(text: bytes, width: int = WIDTH, size: int = BUCKETS) -> tuple[list[np.ndarray], int]:
    """The buckets of a text's features, in some order, and its number of words. A CRC goes on from run to run: that of a longer run starts at the shorter one's."""
    found, n, last = [], 0, []
    for words in pieces(text.translate(WORD_BYTES)):
        n += len(words)
        words = last + words
        crcs, ends = [zlib.crc32(w) for w in words], []
        for k in range(width):
            if k:
                crcs = [*map(zlib.crc32, words[k:], map(zlib.crc32, repeat(b" "), crcs))]
            ends.append(crcs[max(0, len(last) - k) :])  # runs that end in this piece
        found.append((np.fromiter(chain(*ends), np.int64) % size).astype("<u2"))
        last = words[len(words) - width + 1 :] if width > 1 else []
    return found, n


def streams(docs: DataFrame, width: int = WIDTH, size: int = BUCKETS) -> DataFrame:
    """Rows of many documents each: their ids, row keys and numbers of words, the offset at which each one's buckets end, and the packed buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, total = [], [], 0

        def packed() -> pa.RecordBatch:
            ids, keys, words, offsets = zip(*held, strict=True)
            stream = np.concatenate([*parts, np.empty(0, "<u2")]).tobytes()
            long = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array([x], long) for x in (ids, keys, words, offsets)), pa.array([stream], pa.binary())], names=["ids", "keys", "words", "offsets", "stream"])

        for batch in batches:
            for i, key, text in zip(*(batch.column(c) for c in ("doc_id", "rk", "text")), strict=True):
                found, n = buckets(text.as_py() or b"", width, size)
                parts += found
                total += sum(map(len, found))
                held.append((i.as_py(), key.as_py(), n, total))
                if total >= TOGETHER or len(held) >= TOGETHER // 10:
                    yield packed()
                    held, parts, total = [], [], 0
        if held:
            yield packed()

    return docs.select("doc_id", row_key().alias("rk"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), STREAMS)


def counts(written: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: streams are sorted and their runs measured, tasks send a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                s = np.sort(np.frombuffer(stream.as_py(), "<u2"))
                if len(s):
                    starts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
                    total[s[starts]] += np.diff(starts, append=len(s))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for bucket, n in written.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the logarithm of its smoothed share of the target over that of the source, floored."""
    size = len(source)
    s_all, t_all = float(source.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(written: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, rk, n_features, n_words, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, words, offsets, stream in zip(*(batch.column(c) for c in ("ids", "keys", "words", "offsets", "stream")), strict=True):
                ends = offsets.values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                sizes, full = ends - starts, ends > starts
                sums = np.zeros(len(ends), np.int64)
                if full.any():
                    sums[full] = np.add.reduceat(gain[np.frombuffer(stream.as_py(), "<u2")], starts[full])
                weight = np.where(full, sums // np.maximum(sizes, 1), 0)
                noise = np.fromiter((gumbel(i, seed) for i in ids.values.to_pylist()), np.int64, len(ends))
                yield pa.RecordBatch.from_arrays([ids.values, keys.values, pa.array(sizes), words.values, pa.array(weight), pa.array(weight + noise)], names=["doc_id", "rk", "n_features", "n_words", "weight", "score"])

    return written.mapInArrow(tidy(run), SCORED)


def importance_resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, width: int = WIDTH, size: int = BUCKETS) -> DataFrame:
    """A row for each row of docs: doc_id, rk (its row key), n_features, n_words, weight, score, rank.

    Of the N documents of least_words words at least, percent * N / 100 (floored) of the highest scores are drawn, ties to
    the smaller doc_id; rank counts them from 1, and is null for all others.

    docs needs doc_id and text, target a column text; other columns, of any name, are not looked at. Null and empty texts
    have no features and weight 0; a null doc_id is drawn by the digest of "null" and stands after all others of its
    score; repeated rows each count, have one score and ranks of their own. Tables without rows are fine. Texts are taken
    a piece at a time; of very long ones a worker holds the bytes and two more for each feature.
    """
    if not 0 < size <= 1 << 16 or width < 1:
        raise ValueError("buckets are 16-bit numbers, and features have a word at least")
    written = scratch.save(streams(docs.select("doc_id", "text"), width, size), "streams")
    wanted = scratch.save(streams(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), width, size), "target")
    scored = scratch.save(weighed(written, gains(counts(written, size), counts(wanted, size)), seed), "scored")
    scratch.drop("streams", "target")
    able = scored.where(F.col("n_words") >= least_words).withColumns({"__down": -F.col("score"), "__none": F.col("doc_id").isNull(), "__own": F.monotonically_increasing_id()})
    order = ["__down", "__none", "doc_id", "__own"]  # the last parts rows of one id, of which there may be many
    ranked, n = numbered(able.repartitionByRange(*order).sortWithinPartitions(*order).drop("__down", "__none", "__own"), scratch, "ranked", "place")
    drawn = percent * n // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    columns = ["doc_id", "rk", "n_features", "n_words", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of docs that ranks, of importance_resample(docs, ...), draws; of rows alike in doc_id and text all, if one is drawn."""
    drawn = ranks.where("rank IS NOT NULL").select(F.col("rk").alias("__drawn")).distinct()
    return docs.join(drawn, row_key() == F.col("__drawn"), "left_semi")
