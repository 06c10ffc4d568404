"""Byte-level BPE encoding and decoding, by merge ranks.

Each match of the splitting pattern is one piece. Over a piece's byte positions stands a segment tree whose leaves hold
``rank * size + position`` of the pair that begins there, so that its root is the leftmost pair of the least rank. A merge
takes the root's pair and makes three point updates: of the merged token, of its left live neighbour and of the position
that has died. Pieces are encoded many at a time, by numpy, each in its own column of the tree; an encoded piece is kept in
the worker's bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

NONE = np.iinfo(np.int64).max
#: Pieces kept by a worker; the cache is emptied when it is full.
CACHE_PIECES = 250_000
#: Documents are taken together up to so many characters.
CHUNK_CHARS = 1_000_000


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.cache = ranks, {}
        # \s here is Unicode's White_Space, as in the pattern's first home
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary must hold all single bytes")
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        size = max(ranks.values(), default=0) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.frombuffer(b"".join(parts), np.uint8)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make; -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1) if len(self.keys) else np.full(len(key), -1)

    def merge_columns(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids of pieces of at most ``size`` bytes (a power of two), as little-endian 32-bit words."""
        count = len(pieces)
        length = np.array([len(x) for x in pieces], np.int64)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(count, size)
        # rows are positions, columns pieces; row ``size`` stands for the end
        token = np.zeros((size + 1, count), np.int64)
        token[:size] = self.single[raw].T
        position = np.arange(size + 1)[:, None]
        live = position[:size] < length
        after = np.where(position + 1 < length, position + 1, size)
        before = np.broadcast_to(position - 1, (size + 1, count)).copy()
        tree = np.full((2 * size, count), NONE, np.int64)
        if size > 1:
            row, column = np.nonzero(position[: size - 1] + 1 < length)
            rank = self.pair_ranks(token[row, column], token[row + 1, column])
            tree[size + row, column] = np.where(rank < 0, NONE, rank * size + row)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        column = np.nonzero(tree[1] < NONE)[0] if size > 1 else np.zeros(0, np.int64)
        while len(column):
            rank, at = np.divmod(tree[1, column], size)
            dead = after[at, column]
            follows = after[dead, column]
            token[at, column] = rank
            live[dead, column] = False
            after[at, column] = follows
            before[follows, column] = at
            tree[size + dead, column] = NONE
            made = np.where(follows < size, self.pair_ranks(rank, token[follows, column]), -1)
            tree[size + at, column] = np.where(made < 0, NONE, made * size + at)
            left = before[at, column]
            has = left >= 0
            made = self.pair_ranks(token[left[has], column[has]], rank[has])
            tree[size + left[has], column[has]] = np.where(made < 0, NONE, made * size + left[has])
            nodes = [size + at, size + dead, np.where(has, size + left, size + at)]
            while (nodes[0] > 1).any():
                nodes = [np.maximum(x >> 1, 1) for x in nodes]
                for x in nodes:
                    tree[x, column] = np.minimum(tree[2 * x, column], tree[2 * x + 1, column])
            column = column[tree[1, column] < NONE]
        column, row = np.nonzero(live.T)
        ids = token[row, column].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(column, minlength=count)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, texts: Iterable[str]) -> None:
        """Encodes pieces into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self.cache[text] = whole.to_bytes(4, "little")
            else:
                groups.setdefault(1 << (len(data) - 1).bit_length(), []).append((text, data))
        for size, group in groups.items():
            step = max(1, 400_000 // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (text, _), ids in zip(part, self.merge_columns([x[1] for x in part], size), strict=True):
                    self.cache[text] = ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        split = [self.pattern.findall(x) for x in texts]
        wanted = {p for pieces in split for p in pieces}
        if len(self.cache) + len(wanted) > CACHE_PIECES:
            self.cache.clear()
        self.learn(wanted.difference(self.cache))
        found = self.cache.__getitem__
        return [b"".join(map(found, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, gathered from the vocabulary laid end to end."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        length = self.lengths[at]
        ends = np.cumsum(length)
        return self.table[np.repeat(self.starts[at] - ends + length, length) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.from_file(path, pattern)


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit words), decoded (binary) of each row of docs(doc_id, text).

    A null or empty text has no ids and decodes to no bytes. Repeated rows give repeated rows, and other columns, of any name,
    are not looked at. A text of any length is one piece of work; equal texts give equal ids. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            at, texts = 0, batch.column("text").to_pylist()
            for part in chunks(texts):
                ids = bpe.encode_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids binary, decoded binary")
