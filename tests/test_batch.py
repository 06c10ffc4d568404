"""Similarities of many pairs at once against those of one pair."""

import random

import numpy as np

from kinweave.functions import batch
from kinweave.functions import similarity as S


def texts(rng, n, letters="abcé\U0001f600"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 5, 30)))) for _ in range(n)]


def test_equal_to_single_pairs(monkeypatch):
    monkeypatch.setattr(batch, "TOGETHER", 100)
    rng = random.Random(1)
    a, b = texts(rng, 350) + ["", "", "x", "a" * 64, "a" * 65, "ab" * 64], texts(rng, 350) + ["", "x", "", "a" * 64, "a" * 130, "ba" * 70]
    for one, many in ((S.lcs, batch.common), (S.ratio, batch.ratios), (S.token_sort, batch.token_sorts), (S.token_set, batch.token_sets)):
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b, strict=True)]
        assert many([], []).tolist() == []


def test_best_windows(monkeypatch):
    rng = random.Random(2)
    a, b = (texts(rng, 120, "abcdefghijklmnopqrstuvwxyz") for _ in "ab")
    looked, plain = [], batch.common
    monkeypatch.setattr(batch, "common", lambda x, y: looked.append(len(x)) or plain(x, y))
    assert batch.partials(a, b).tolist() == [S.partial(x, y) for x, y in zip(a, b, strict=True)]
    windows = sum(len(x) + len(y) - 1 for x, y in zip(a, b, strict=True) if x and y)
    assert sum(looked) < windows / 3  # no common subsequence at every offset
    assert batch.wratios(a, b).tolist() == [S.wratio(x, y) for x, y in zip(a, b, strict=True)]


def test_udf_with_nulls_and_repeats(spark):
    rows = [("ab", "ba"), (None, "x"), (None, None), ("ab", "ba"), ("", "")] * 3
    got = spark.createDataFrame(rows, "a string, b string").select(S.ratio_udf("a", "b").alias("r"), S.jaro_winkler_udf("a", "b").alias("j")).collect()
    assert [(r.r, r.j) for r in got] == [(S.ratio(x or "", y or ""), S.jaro_winkler(x or "", y or "")) for x, y in rows]


def test_bounds_are_no_less_than_any_length():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc"), n)) for n in sorted(rng.integers(1, 30, 2)))
        windows = batch.Windows(a, b)
        lengths = np.array([S.lcs(a, b[s:e]) for s, e in zip(windows.start, windows.end, strict=True)])
        assert (lengths <= windows.most).all()
        which = windows.first()
        windows.told(which, lengths[which])
        assert (lengths <= windows.most).all()


def test_equal_to_single_pairs_of_names(monkeypatch):
    """Jaro-Winkler similarities and edit distances of many pairs, also of texts of over a word of 64 bits."""
    monkeypatch.setattr(batch, "TOGETHER", 100)
    rng = random.Random(3)
    a, b = texts(rng, 350) + ["", "", "x", "martha", "a" * 65, "ab" * 64], texts(rng, 350) + ["", "x", "", "marhta", "a" * 130, "ba" * 70]

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            old, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != e))
        return row[-1]

    assert batch.jaro_winklers(a, b).tolist() == [S.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]
    assert batch.levenshteins(a, b).tolist() == [edits(x, y) for x, y in zip(a, b, strict=True)]
    assert batch.jaro_winklers([], []).tolist() == batch.levenshteins([], []).tolist() == []
