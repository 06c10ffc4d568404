"""Lists of ids as bytes, and the votes of such lists, by numpy for many rows at once.

Ids like S2-000123 are numbers, whose lists are differences of a byte or more each; any others stay as they are, in lists beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An id's letter and digits: S, a digit, a hyphen, and 6 to 8 digits, more than 6 only if the first is no 0.
BASE, SHORT = 10**8, 6
#: Ids that are worked on together, about.
TOGETHER = 2_000_000
#: Ids that are no numbers are numbered from here on, as they come.
OTHER = 1 << 31

VOTED = "struct<codes: array<int>, votes: array<int>, others: array<string>>"


def number(entity_id: Column) -> Column:
    """The number of an id, null for those that are not of the form."""
    n = F.substring(entity_id, 2, 1).try_cast("int") * BASE + F.substring(entity_id, 4, 8).try_cast("int")
    return F.when(written(n) == entity_id, n)


def written(n: Column) -> Column:
    """The id of a number."""
    digits, least = (n + 10 * BASE).cast("string"), n % BASE  # 1, the digit after S, and 8 digits
    short = F.when(least < 10**SHORT, F.substring(digits, 5, 6)).when(least < 10 ** (SHORT + 1), F.substring(digits, 4, 7)).otherwise(F.substring(digits, 3, 8))
    return F.concat(F.lit("S"), F.substring(digits, 2, 1), F.lit("-"), short)


def in_text_order(n: np.ndarray) -> np.ndarray:
    """Numbers that are in the order of the ids as texts."""
    digits = n % BASE
    long = (digits >= 10**SHORT).astype(np.int64) + (digits >= 10 ** (SHORT + 1))
    return (n - digits + digits * 10 ** (2 - long)) * 4 + long


def packed(lists: pa.Array) -> pa.Array:
    """Bytes of lists of numbers: sorted, as differences, seven bits a byte, the last byte of each without its highest bit."""
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values, row = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
    values = values[np.lexsort((values, row))]
    ends = np.cumsum(counts)
    steps = np.diff(values, prepend=0)
    first = (ends - counts)[counts > 0]
    steps[first] = values[first]
    size = 1 + sum((steps >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    last = np.cumsum(size)
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(5):
        able = np.flatnonzero(size > i)
        out[(last - size)[able] + i] = (steps[able] >> 7 * i & 127) | np.where(size[able] > i + 1, 128, 0)
    offsets = np.concatenate([[0], last])[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed lists, and how many each list has."""
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    data = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[:1]
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends + 1])[: len(ends)]
    place = np.arange(len(data)) - np.repeat(starts, ends + 1 - starts)
    steps = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts) if len(ends) else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, offsets)) if len(lists) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[1:] - np.repeat(total[(np.cumsum(counts) - counts)], counts), counts


def voted(lists: pa.Array, others: pa.Array, most: int | None) -> pa.Array:
    """Of each row's lists, the different ids with how often each occurs; the best ``most``, equal ones by id as text."""
    bytes_of = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False))])
    rows = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    parts = (bytes_of[rows] // TOGETHER).astype(np.int64)  # an id is a byte at least
    cuts = [0, *(np.flatnonzero(np.diff(parts[:-1])) + 1).tolist(), len(lists)] if len(lists) else [0, 0]
    done = [voted_rows(lists.slice(a, b - a), others.slice(a, b - a), most) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(done)


def ranks(codes: np.ndarray, names: list[str]) -> np.ndarray:
    """The order of ids as texts."""
    if not names:
        return in_text_order(codes)
    different, at = np.unique(codes, return_inverse=True)
    texts = [names[c - OTHER] if c >= OTHER else f"S{c // BASE}-{c % BASE:06}" for c in different.tolist()]
    place = np.empty(len(texts), np.int64)
    place[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    return place[at]


def voted_rows(lists: pa.Array, others: pa.Array, most: int | None) -> pa.Array:
    n = len(lists)
    owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    codes, counts = unpacked(lists.flatten())
    owner = np.repeat(owner, counts)
    more = others.flatten().dictionary_encode()
    names = more.dictionary.to_pylist()
    codes = np.concatenate([codes, OTHER + more.indices.to_numpy(zero_copy_only=False).astype(np.int64)])
    owner = np.concatenate([owner, np.repeat(np.arange(n), pc.list_value_length(others).to_numpy(zero_copy_only=False))])
    both, votes = np.unique(owner << 32 | codes, return_counts=True)
    owner, codes = both >> 32, both & 0xFFFFFFFF
    size = np.bincount(owner, minlength=n)
    if most is not None and (size > most).any():
        order = np.lexsort((ranks(codes, names), -votes, owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        keep = order[place < most]
        owner, codes, votes = owner[keep], codes[keep], votes[keep]
        size = np.minimum(size, most)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    strange = codes >= OTHER
    kept = pa.array([names[i] for i in codes[strange] - OTHER], pa.string())
    before = np.concatenate([[0], np.cumsum(np.bincount(owner[strange], minlength=n))])
    codes = np.where(strange, before[owner] - np.cumsum(strange), codes)  # below 0: the places in the row's own list of others, from -1 on
    columns = [pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(votes, pa.int32())), pa.ListArray.from_arrays(pa.array(before, pa.int32()), kept)]
    return pa.StructArray.from_arrays(columns, names=["codes", "votes", "others"])


def packed_udf(lists: Column) -> Column:
    def run(lists: pa.Array) -> pa.Array:
        return packed(lists)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(lists)


def voted_udf(lists: Column, others: Column, most: int | None) -> Column:
    def run(lists: pa.Array, others: pa.Array) -> pa.Array:
        return voted(lists, others, most)

    run.__annotations__ = {"lists": pa.Array, "others": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, VOTED)(lists, others)
