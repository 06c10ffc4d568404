"""Word shingles of many texts at once, as 64-bit hashes, by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that part words.
GAPS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_GAP = np.isin(np.arange(256), GAPS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RANDOM = np.random.default_rng(20240229)
OF_BYTE = RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    have = POWERS.get(base)
    if have is None or len(have) < count:
        factors = np.full(1 << max(20, (count - 1).bit_length()), base, np.uint64)
        factors[0] = 1
        have = POWERS[base] = np.cumprod(factors)
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, from one running sum."""
    terms = OF_BYTE[data]
    terms *= powers(BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * C)


@dataclass
class Shingled:
    """Distinct shingle hashes of texts, sorted within each text: those of text i are hashes[bounds[i]:bounds[i + 1]]."""

    hashes: np.ndarray
    bounds: np.ndarray
    n_words: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def reduce(self, f: np.ufunc, values: np.ndarray, empty: int) -> np.ndarray:
        """f over the values of each text's hashes."""
        full = self.bounds[1:] > self.bounds[:-1]
        out = np.full((len(full), *values.shape[1:]), empty, values.dtype)
        if full.any():
            out[full] = f.reduceat(values, self.bounds[:-1][full])
        return out

    def set_hash(self) -> np.ndarray:
        """Of equal sets it is equal; 64 bits."""
        return mix(self.reduce(np.add, mix(self.hashes ^ C), 0) + (self.bounds[1:] - self.bounds[:-1]).astype(np.uint64)).view(np.int64)


def shingle(texts: list[str | None], width: int) -> Shingled:
    """Shingles of so many words, A-Z lower-cased. Fewer words are one shingle; a null text has none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    data = LOWER[np.frombuffer(b" ".join([*parts, b""]), np.uint8)]
    gap = IS_GAP[data]
    edges = np.diff(np.concatenate([[True], gap]).astype(np.int8))  # the last byte is a gap
    starts, ends = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
    words = range_hash(data, starts, ends)
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    h = words
    count = max(0, len(words) - width + 1)
    if count:
        h = words[:count]
        for k in range(1, width):
            h = mix(h * C + words[k : k + count])
        whole = owner[:count] == owner[width - 1 :]
        h, of = h[whole], owner[:count][whole]
    else:
        h, of = words[:0], owner[:0]
    short = np.nonzero((n_words > 0) & (n_words < width))[0]
    if len(short):
        first = np.searchsorted(owner, short)
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n_words[short] > k
            own[has] = mix(own[has] * C + words[first[has] + k] + np.uint64(k + 1))
        h, of = np.concatenate([h, own]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    if len(h):
        fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return Shingled(h[fresh], np.searchsorted(of[fresh], np.arange(len(texts) + 1)), n_words)
