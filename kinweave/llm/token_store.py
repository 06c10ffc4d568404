"""Token ids in a byte-aligned store.

Ids are counted over the whole corpus and numbered by falling frequency, so that common ids take one byte. A block holds the
ids of consecutive documents as two byte strings: control bytes of four 2-bit lengths each, and data bytes, one to four for
each id. It is read back by a 256-row table of lengths and a gather. Blocks are rows of Parquet files, which Spark commits
whole and any store can hold; so are the ids of the ranks and the shards' offsets.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .shingles import LOWER, mix

#: The four lengths that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Pieces and chunks kept by a worker; both are emptied when one is full. SLOTS rows of 32 bytes hold the pieces.
CACHE_PIECES, CACHE_CHUNKS, SLOTS = 1_000_000, 200_000, 1 << 21
#: Pieces that are given to the tokenizer as one text.
WORDS_TOGETHER = 200
#: Bytes of the longest piece in the table, and masks of the first 0 to 8 bytes of a word.
WIDEST, MASKS = 24, np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Classes of bytes, ASCII.
GAP, LETTER, SIGN, DIGIT, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[ord(x) for x in " \n\r\t"]] = GAP
for name, runs in ((LETTER, ("AZ", "az")), (SIGN, ("!/", ":@", "[`", "{~")), (DIGIT, ("09",))):
    for a, b in runs:
        CLASS[ord(a) : ord(b) + 1] = name
#: A block is closed at so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Texts of so many characters in all are encoded at a time.
ARRAY_CHARS = 2_000_000
BLOCKS = "shard int, start long, doc_ids array<long>, counts array<int>, control binary, data binary"
#: Stands for a null id in the order.
LEAST = np.iinfo(np.int64).min


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    length = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    keep = np.arange(4) < length[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


class Pieces:
    """Ids of pieces of up to WIDEST bytes, in a table with open addressing that numpy looks up: a row holds a piece's bytes as three words and its number plus one."""

    def __init__(self, kind: str):
        self.table, self.first, self.count, self.ids, self.size, self.used = np.zeros((SLOTS, 4), np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, kind), 0, 0

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 0] + mix(keys[:, 1] + mix(keys[:, 2]))) & np.uint64(SLOTS - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        out, left, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self.slots(keys)
        while len(left):
            rows = self.table[at]
            same = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2]) & (rows[:, 3] != 0)
            out[left[same]] = rows[same, 3].astype(np.int64) - 1
            on = np.nonzero(~same & (rows[:, 3] != 0))[0]
            left, keys, at = left[on], keys[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Keys that differ and are not there yet."""
        at = self.slots(keys)
        while len(keys):
            free = np.nonzero(self.table[at, 3] == 0)[0]
            first = free[np.unique(at[free], return_index=True)[1]]  # of those that meet at a free row one gets it
            self.table[at[first], :3], self.table[at[first], 3] = keys[first], numbers[first].astype(np.uint64) + np.uint64(1)
            on = np.ones(len(keys), bool)
            on[first] = False
            keys, numbers, at = keys[on], numbers[on], (at[on] + 1) & (SLOTS - 1)

    def learn(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New numbers for as many pieces as there are counts; ids stand one after another."""
        numbers = np.arange(self.size, self.size + len(counts))
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])
        self.size, self.used, at = self.size + len(counts), self.used + len(ids), self.used
        self.first, self.count, self.ids = grown(self.first, self.size), grown(self.count, self.size), grown(self.ids, self.used)
        self.first[numbers], self.count[numbers], self.ids[at : self.used] = at + np.cumsum(counts) - counts, counts, ids
        return numbers


class Chunked:
    """A tokenizer whose words never reach over white space.

    Texts are cut into pieces by classes of bytes: runs of Latin letters, runs of ASCII signs and single digits, of which the
    tokenizer makes words of their own, lower-cased. A chunk between white space with anything else in it is one piece. Each
    different piece is given to the tokenizer once and kept; the rest is array lookups.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for lower-cased pieces, which normalizing leaves alone and blanks part
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size()
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        probes = {"Straße,": ["straße", ","], "Ab12--c.": ["ab", "1", "2", "--", "c", "."]}
        #: Else every chunk goes to the tokenizer whole.
        self.parts = all(one(x) == [i for y in parts for i in one(y)] == self.plain.encode(" ".join(parts), add_special_tokens=False).ids for x, parts in probes.items())
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.pieces, self.whole = None, {}

    def encoded(self, items: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of items, one after another, and how many each has."""
        got = [np.array(e.ids, kind) for i in range(0, len(items), 20_000) for e in self.tokenizer.encode_batch_fast(items[i : i + 20_000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, kind), *got]), np.array([len(x) for x in got], np.int64)

    def encoded_plain(self, words: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces: each ends with its one token that ends a word, so that many can be encoded as one text."""
        ids, counts = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
        groups = [words[i : i + WORDS_TOGETHER] for i in range(0, len(words), WORDS_TOGETHER)]
        for group, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(e.ids, kind)
            n = np.diff(np.nonzero(self.ends[own])[0] + 1, prepend=0)
            own, n = (own, n) if len(n) == len(group) else self.encoded(group, kind)
            ids.append(own)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and of each piece its first byte, the byte behind it, and whether it is plain; data ends with WIDEST blanks."""
        kind, low = CLASS[data], LOWER[data]
        lead = np.nonzero(data == 0xC3)[0]
        second = data[lead + 1]
        latin = (second != 0x97) & (second != 0xB7)  # but for the signs of multiplication and division
        lead, second = lead[latin], second[latin]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead[second <= 0x9E] + 1] += 0x20
        if self.added:
            text = low.tobytes()
            for token in self.added:
                at = text.find(token)
                while at >= 0:
                    kind[at] = OTHER
                    at = text.find(token, at + 1)
        edges = np.diff(np.concatenate([[True], kind == GAP]).astype(np.int8))  # the last byte is a gap
        starts, ends = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
        if not len(starts):
            return low, starts, ends, np.zeros(0, bool)
        hard = kind == OTHER
        hard[:-1] |= (data[:-1] == 0x27) & (kind[1:] == LETTER)  # the tokenizer has words like 's
        hard = np.logical_or.reduceat(hard, starts) if self.parts else np.ones(len(starts), bool)
        size = (ends - starts)[hard]
        kind[np.arange(size.sum()) + np.repeat(starts[hard] - (np.cumsum(size) - size), size)] = OTHER
        bounds = np.concatenate([[0], np.nonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))[0] + 1, [len(data)]])
        own = kind[bounds[:-1]]
        full = own != GAP
        starts, ends = bounds[:-1][full], bounds[1:][full]
        return low, starts, ends, (own[full] != OTHER) & (ends - starts <= WIDEST)

    def encode(self, texts: list[str], end: int, kind: str) -> list[bytes]:
        """The ids of each text, and the end id."""
        last = np.array([end], kind).tobytes()
        parts = [t.encode() for t in texts]
        raw = b" ".join([*parts, b" " * (WIDEST + 8)])
        data = np.frombuffer(raw, np.uint8)
        low, starts, ends, plain = self.cut(data)
        if not len(starts):
            return [last] * len(texts)
        if self.pieces is None or self.pieces.size > CACHE_PIECES or len(self.whole) > CACHE_CHUNKS:
            self.pieces, self.whole = Pieces(kind), {}
        known, numbers = self.pieces, np.full(len(starts), -1, np.int64)
        at = np.nonzero(plain)[0]
        first, size = starts[at], (ends - starts)[at]
        view = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))
        keys = np.stack([view[first + 8 * k] & MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(WIDEST // 8)], axis=1)
        found = known.find(keys)
        new = np.nonzero(found < 0)[0]
        if len(new):
            text = low.tobytes()
            words = list({text[a:b] for a, b in zip(first[new].tolist(), ends[at[new]].tolist(), strict=True)})
            known.put(np.frombuffer(b"".join(w.ljust(WIDEST, b"\0") for w in words), "<u8").reshape(-1, WIDEST // 8), known.learn(*self.encoded_plain([w.decode() for w in words], kind)))
            found[new] = known.find(keys[new])
        numbers[at] = found
        rest = np.nonzero(~plain)[0]
        chunks = [raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        if missing := list(set(chunks).difference(self.whole)):
            self.whole.update(zip(missing, known.learn(*self.encoded(missing, kind)).tolist(), strict=True))
        numbers[rest] = [self.whole[c] for c in chunks]
        count = known.count[numbers]
        stops = np.cumsum(count)
        out = known.ids[np.arange(stops[-1]) + np.repeat(known.first[numbers] - (stops - count), count)].tobytes()
        words = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
        cuts = (np.concatenate([[0], stops])[words] * known.ids.itemsize).tolist()
        return [out[a:b] + last for a, b in zip([0, *cuts], cuts, strict=False)]


@lru_cache(maxsize=2)
def loaded(path: str) -> Chunked:
    return Chunked(path)


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """Bounds of shards by doc_id; an id that fills several shards stands there several times."""
    if shards < 2:
        return np.zeros(0, np.int64)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LEAST))).alias("id"))
    return np.array(ids.approxQuantile("id", [i / shards for i in range(1, shards)], 0.2 / shards)).astype(np.int64)


def shard_of(bounds: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Shards in the order of ids; an id that has several bounds is shared out by its ties, evenly spread 64-bit values, in their order."""
    base = np.searchsorted(bounds, ids, "left")
    times = np.searchsorted(bounds, ids, "right") - base
    return (base + np.where(times > 0, np.floor((ties / 2.0**64 + 0.5) * times).clip(0, np.maximum(times - 1, 0)) + 1, 0)).astype(np.int32)


#: Bytes of text of a shard, about, where a shard for each of Spark's partitions would hold more.
SHARD_BYTES = 256 << 20


def write_store(spark: SparkSession, docs: DataFrame, path: str, end: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order; the tables blocks, ranks (rank, id) and offsets (shard, offset) of the store.

    Files are in order: a shard is a file, shards are ranges of doc_id, and within a file blocks follow one another. Rows with
    equal doc_id follow the order of their texts' hashes, over several shards if there are many; a null id comes first; a null
    or empty text has the end id only. Repeated rows are stored each. An empty table has no blocks. Long texts are blocks of their
    own. Other columns are not read. The tokenizer's words must not reach over blanks, tabs or line ends.
    """
    size = max(loaded(path).size, end + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    bounds = shard_bounds(docs, shards)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import chunks

        encoder = loaded(path)
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist(), ARRAY_CHARS):
                coded = encoder.encode(part, end, kind)
                rows = batch.slice(at, len(part))
                key = rows.column("doc_id").fill_null(LEAST).to_numpy(zero_copy_only=False)
                shard = shard_of(bounds, key, rows.column("tie").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tie"), pa.array(shard), pa.array([len(x) // width for x in coded], pa.int32()), pa.array(coded, pa.binary())],
                    names=["doc_id", "tie", "shard", "n", "ids"],
                )
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    made = rows.mapInArrow(tidy(tokens), "doc_id long, tie long, shard int, n int, ids binary")
    held = scratch.save(made, "ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # at most a row for each id of the vocabulary, and one for each shard, comes to the driver
    total = np.zeros(size, np.int64)
    for r in held.select("ids").mapInArrow(tidy(counted), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    by_rank = np.lexsort((np.arange(size), -total)).astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    in_shard = {r.shard: r.n for r in held.groupBy("shard").agg(F.sum(F.col("n").cast("long")).alias("n")).collect()}
    offsets, before = [], 0
    for shard in sorted(in_shard):
        offsets.append((shard, before))
        before += in_shard[shard]
    ranks = scratch.save(spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id int").coalesce(1), "store/ranks", release=False)
    starts = scratch.save(spark.createDataFrame(offsets, "shard int, offset long").coalesce(1), "store/offsets", release=False)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

        def closed(shard: int, start: int, part: list[tuple]) -> pa.RecordBatch:
            control, data = pack(rank[np.frombuffer(b"".join(x[2] for x in part), kind)])
            row = (shard, start, [x[0] for x in part], [x[1] for x in part], control, data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        part, count, last, begins = [], 0, None, 0
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
                if part and (shard != last or count + row[1] > BLOCK_IDS):
                    yield closed(last, begins, part)
                    part, count, begins = [], 0, begins + count if shard == last else 0
                part.append(row)
                count, last = count + row[1], shard
        if part:
            yield closed(last, begins, part)

    # a partition is a shard, and a file
    ordered = held.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie").select("shard", "doc_id", "n", "ids")
    stored = scratch.save(ordered.mapInArrow(tidy(blocks), BLOCKS), "store/blocks")
    scratch.drop("ids")
    return stored, ranks, starts


def open_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a store that write_store left in ``folder``."""
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "ranks", "offsets"))


def read_store(blocks: DataFrame, ranks: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian 32-bit words), from the tables of a store alone."""
    # a row for each id of the vocabulary and one for each shard
    by_rank = np.array([r.id for r in sorted(ranks.collect())], np.uint32)
    before = {r.shard: r.offset for r in offsets.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, doc_ids, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = by_rank[unpack(control, data, sum(n))].astype("<u4")
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(before[shard] + start + ends - n), pa.array(n, pa.int64()), pa.array([ids[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")
