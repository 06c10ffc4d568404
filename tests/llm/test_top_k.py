"""Exact top-k against all pairs: copies, ties, odd vectors, and numbers near the limits."""

import math
import random

import numpy as np
import pytest

from kinweave.llm import top_k
from kinweave.llm.common import Scratch


def brute(rows, every=50, k=5):
    able = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(256 * float(np.float32(x))) for x in v]
            able[i] = min(able.get(i, own), own)
    out = []
    for q in (i for i in able if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(able[q], v, strict=False)), i) for i, v in able.items() if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **settings):
    schema = "vec_id long, embedding array<float>, vec string, cid string, q string, score string, ids string, place string, list0 string"
    frame = spark.createDataFrame([(*r, *"abcdefg") for r in rows], schema)
    return sorted(tuple(r) for r in top_k.top_k(frame, Scratch(spark, "t"), **settings).select("query_id", "rank", "vec_id", "score").collect())


def test_copies_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BATCH", 11)  # several batches
    rng = random.Random(5)
    hot = [rng.gauss(0, 0.2) for _ in range(6)]
    rows = [(i, hot if rng.random() < 0.4 else [rng.choice((-0.5, 0.0, 0.25)) for _ in range(6)] if rng.random() < 0.3 else [x + rng.gauss(0, 0.03) for x in hot]) for i in range(-100, 700)]
    rows += [(1050, None), (1100, [0.5, None, 0.0, 0.0, 0.0, 0.0]), (1150, [0.5, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1200, [float("inf")] + [0.0] * 5), (None, hot), (1250, []), (1300, hot[:3]), (50, hot), (50, hot), (100, [9.0] * 6)]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    rows = [(0, [1.0, 2.0]), (7, [1.0, 2.0]), (50, [-1.0, 0.0]), (60, [1.0])]
    assert found(spark, rows, lists=5, k=2) == brute(rows, k=2)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for high in (200, 1 << 28, 1 << 30):
        a, b = rng.integers(-high, high, (5, 6)), rng.integers(-high, high, (4, 6))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert top_k.products(a, b).tolist() == want
    with pytest.raises(OverflowError):
        top_k.products(np.full((1, 6), 1 << 40), np.full((1, 6), 1 << 40))
