"""Passages of many words that repeat, whatever their line breaks, by content-defined windows.

A window is ``WIDTH`` words in a row, A-Z lower-cased, with any blanks and line ends between them. Its mark is the least hash of
its runs of ``RUN`` words: windows that are equal have one mark, so only windows whose mark stands at two places at least are
compared. Of equal windows the first one stays; a passage of more words is the union of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import chunks
from .common import tidy
from .shingles import BASE, INVERSE, IS_GAP, LOWER, mix, powers, range_hash

#: A passage of over 50 words repeats; WIDTH - RUN + 1 runs stand in a window, and two of that many and one are marks: shorter runs make fewer marks.
WIDTH, RUN = 51, 13
CHUNK_CHARS = 1_000_000
#: A place holds a word's number in so many bits, and above them a document's: 2**35 documents of 2**28 words.
WORD_BITS = 28


def sliding(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """f over each n neighbours."""
    have = 1
    while 2 * have <= n:
        x, have = f(x[:-have], x[have:]), 2 * have
    return f(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


@dataclass
class Windows:
    """Of texts: the first byte of each word, the words before each text, and for each place of a window its text, word, hash and mark."""

    starts: np.ndarray
    before: np.ndarray
    bytes_before: np.ndarray
    of: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    marks: np.ndarray
    marked: tuple[np.ndarray, np.ndarray]  # text and hash of each run that is a mark


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, first and last bytes of their words, and the bytes before each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    data = LOWER[np.frombuffer(b" ".join([*parts, b""]), np.uint8)]
    edges = np.diff(np.concatenate([[True], IS_GAP[data]]).astype(np.int8))  # the last byte is a gap
    return data, np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0], np.concatenate([[0], np.cumsum(sizes)])


def windows(texts: list[str | None], marks_only: bool = False) -> Windows:
    """marks_only leaves out what is known of each window."""
    data, starts, ends, bytes_before = words_of(texts)
    owner = np.searchsorted(bytes_before[1:], starts, "right")
    before = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return Windows(starts, before, bytes_before, none, none, none, none, (none, none))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(range_hash(data, starts, ends)) * powers(BASE, n), out=total[1:])
    run = lambda k: mix((total[k:] - total[:-k]) * powers(INVERSE, n + 1)[: n + 1 - k] + np.uint64(k))
    runs = run(RUN)
    marks = sliding(np.minimum, runs, WIDTH - RUN + 1)
    whole = owner[: n - WIDTH + 1] == owner[WIDTH - 1 :]
    # a run is a mark if the greatest of the marks of the windows that hold it is its own hash
    reach = np.zeros(n - WIDTH + 1 + 2 * (WIDTH - RUN), np.uint64)
    reach[WIDTH - RUN : WIDTH - RUN + len(marks)] = np.where(whole, marks, np.uint64(0))
    is_mark = np.nonzero(sliding(np.maximum, reach, WIDTH - RUN + 1) == runs)[0]
    marked = owner[is_mark], runs[is_mark].view(np.int64)
    if marks_only:
        return Windows(starts, before, bytes_before, none, none, none, none, marked)
    place = np.nonzero(whole)[0]
    return Windows(starts, before, bytes_before, owner[place], place - before[owner[place]], run(WIDTH)[place].view(np.int64), marks[place].view(np.int64), marked)


def placed(rows: DataFrame) -> DataFrame:
    """(pos, h, mark): the windows of rows(o, text, marks) that have one of the marks; pos holds the row's place in the order, o, and the first word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist(), CHUNK_CHARS):
                got, rows = windows(part), batch.slice(at, len(part))
                wanted = rows.column("marks").to_pylist()
                bounds = np.searchsorted(got.of, np.arange(len(part) + 1))
                keep = np.concatenate([np.zeros(0, bool), *(np.isin(got.marks[a:b], np.array(m, np.int64)) for a, b, m in zip(bounds[:-1], bounds[1:], wanted, strict=True))])
                pos = rows.column("o").to_numpy()[got.of[keep]] << WORD_BITS | got.at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(got.hashes[keep]), pa.array(got.marks[keep])], names=["pos", "h", "mark"])
                at += len(part)

    return rows.select("o", "text", "marks").mapInArrow(tidy(run), "pos long, h long, mark long")


def cut(texts: list[str], gone: list[list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Of each text: it without the ranges of words in gone and the blanks behind them, the words removed, and their spans."""
    _, starts, _, bytes_before = words_of(texts)
    before = np.searchsorted(starts, bytes_before)
    for i, (text, ranges) in enumerate(zip(texts, gone, strict=True)):
        own, data = starts[before[i] : before[i + 1]] - bytes_before[i], text.encode("utf-8", "surrogatepass")
        out, last, end, removed, spans = [], 0, -1, 0, 0
        for a, b in sorted(ranges):
            if b > end:
                out.append(data[last : max(last, own[a])])
                last = own[b] if b < len(own) else len(data)
                removed, spans, end = removed + b - max(a, end), spans + (a > end), b
        yield b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass"), removed, spans
