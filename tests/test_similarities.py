"""All similarities of records in one pass, and windows of short strings without objects for each pair."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinweave.functions import batch
from kinweave.functions import similarity as S

PLAIN = {"ratio": S.ratio, "wratio": S.wratio, "token_set": S.token_set, "token_sort": S.token_sort, "jaro": S.jaro_winkler}


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcé𝒳") for _ in range(r.choice((1, 3, 9, 40)))) for _ in range(r.choice((0, 1, 2, 4)))) for _ in range(n)]


def test_one_pass_equals_plain_functions():
    sides = [(texts(300, i), texts(300, 10 + i)) for i in range(4)]
    sides[1] = sides[0]  # cores that are the names
    found = batch.similarities(*sides)
    assert list(found) == list(batch.SIMILARITIES)
    for name, (side, kind) in batch.SIMILARITIES.items():
        assert np.array_equal(found[name], [PLAIN[kind](a, b) for a, b in zip(*sides[side], strict=True)]), name


def test_short_windows_are_stepped_through_together(monkeypatch):
    monkeypatch.setattr(batch, "Windows", lambda *_: pytest.fail("an object for each pair"))
    a = [t[:64] for t in texts(700, 5)]
    b = texts(700, 6)
    assert np.array_equal(batch.partials(a, [t[:64] for t in b]), [S.partial(x, y[:64]) for x, y in zip(a, b, strict=True)])


def test_texts_of_one_and_several_words_of_bits():
    a, b = [*texts(200, 7), "a" * 64, "ab" * 40, "", "x" * 200], [*texts(200, 8), "a" * 65, "ba" * 70, "abc", "x" * 63]
    assert batch.common(a, b).tolist() == [S.lcs(x, y) for x, y in zip(a, b, strict=True)]


def test_ratios_of_arrow_columns_know_each_text_once(monkeypatch):
    a, b = [*texts(50, 1), None, "", None] * 20, [*texts(50, 2), "a", None, ""] * 20
    seen, coded = [], batch.coded
    monkeypatch.setattr(batch, "coded", lambda t: seen.append(len(t)) or coded(t))
    assert np.array_equal(S.ratios_of(pa.array(a), pa.array(b)), [S.ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])
    assert seen == [len({x or "" for x in [*a, *b]})]
    assert len(S.ratios_of(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
