"""String similarities, as Python functions over two strings, which say what they are, and as pandas UDFs over many pairs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import batch
from .batch import LONGER, MUCH_LONGER, PART_WEIGHT, SHORT_PART_WEIGHT, TOKEN_WEIGHT


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine operation a character of b for short a (bits of one integer)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 1.0
    common, left, right = (" ".join(sorted(s)) for s in (both, x - y, y - x))
    left, right = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = ratio(left, right)
    return max(best, ratio(common, left), ratio(common, right)) if both else best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows over its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    best = ratio(a, b)
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < LONGER:
        return max(best, TOKEN_WEIGHT * token_sort(a, b), TOKEN_WEIGHT * token_set(a, b))
    weight = PART_WEIGHT if spread <= MUCH_LONGER else SHORT_PART_WEIGHT
    x, y = set(a.split()), set(b.split())
    sort = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    subset = 1.0 if x & y else partial(" ".join(sorted(x - y)), " ".join(sorted(y - x)))
    return max(best, weight * partial(a, b), TOKEN_WEIGHT * weight * sort, TOKEN_WEIGHT * weight * subset)


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    m = len(left)
    moved = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def vectorized(function):
    """A pandas UDF of a function of two lists of strings; pairs that repeat in a batch are computed once. Nulls count as ''."""

    def apply(a, b):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            (x, xs), (y, ys) = (pd.factorize(s.fillna("")) for s in (a, b))
            pairs, at = np.unique(x * np.int64(len(ys)) + y, return_inverse=True)
            return pd.Series(function(list(xs[pairs // len(ys)]), list(ys[pairs % len(ys)]))[at], dtype="float64")

        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, DoubleType())(a, b)  # made when used: workers import this module without a session

    return apply


def ratios_of(a: pa.Array, b: pa.Array) -> np.ndarray:
    """batch.ratios of Arrow columns, of which only different texts become strings of Python. Nulls count as ''."""
    both = pc.fill_null(pa.concat_arrays([a, b]), "").dictionary_encode()
    texts, at = both.dictionary.to_pylist(), both.indices.to_numpy().astype(np.int64)
    pairs, where = np.unique(at[: len(a)] * max(len(texts), 1) + at[len(a) :], return_inverse=True)
    x, y = np.divmod(pairs, max(len(texts), 1))
    codes, starts, sizes = batch.coded(texts)
    total = sizes[x] + sizes[y]
    return np.where(total == 0, 1.0, 2 * batch.common_of(codes, starts, sizes, x, y) / np.maximum(total, 1))[where]


def ratio_udf(a, b):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(ratios_of(a, b), pa.float64())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, DoubleType())(a, b)


token_sort_udf, token_set_udf, partial_udf, wratio_udf = map(vectorized, (batch.token_sorts, batch.token_sets, batch.partials, batch.wratios))
jaro_winkler_udf, levenshtein_udf = vectorized(batch.jaro_winklers), vectorized(batch.levenshteins)


def similarities_udf(*columns: Column) -> Column:
    """A struct of batch.SIMILARITIES, from names, cores, addresses and original names, of both records each. Nulls count as ''."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series) -> pd.DataFrame:
        lists = [s.fillna("").tolist() for s in (a, b, c, d, e, f, g, h)]
        return pd.DataFrame(batch.similarities(*zip(lists[::2], lists[1::2], strict=True)))

    run.__annotations__ = dict.fromkeys("abcdefgh", pd.Series) | {"return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{n} double" for n in batch.SIMILARITIES))(*columns)
