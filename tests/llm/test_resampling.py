"""Importance resampling against a plain version over whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from kinweave.llm import resampling
from kinweave.llm.common import Scratch

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)], len(w)


def brute(rows, target, width=2, size=10000, percent=25, least=20):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % size for t in texts for f in features(t, width)[0])

    s, t, out = count(r[1] for r in rows), count(target), []
    s_all, t_all = float(sum(s.values()) + size), float(sum(t.values()) + size)
    for doc_id, text in rows:
        found, n_words = features(text, width)
        gains = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in (zlib.crc32(f.encode()) % size for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words, None])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = i
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in out), key=repr)


def found(spark, rows, target, **settings):
    docs = spark.createDataFrame([(*r, *"abcde") for r in rows], "doc_id long, text string, rk string, rank string, place string, stream string, ids string")
    items = spark.createDataFrame([(t, "z") for t in target], "text string, doc_id string")
    got = resampling.importance_resample(docs, items, Scratch(spark, "t"), **settings)
    return docs, got


def values(got):
    return sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize(("width", "size", "piece"), [(2, 10000, 1 << 20), (3, 65536, 7)])
def test_resampling(spark, documents, texts, monkeypatch, width, size, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "TOGETHER", 3000)
    rows = [(i - 40, t) for i, t in enumerate(texts)] + [(None, None), (None, "a b c " * 30), (7000, " "), (7001, "word " * 40), (7001, "word " * 40), (7002, "long Été " * 2_000)]
    target = [r["text"] for r in documents[:9]] + [None, "", "日本 a b"]
    _, got = found(spark, rows, target, width=width, size=size)
    assert values(got) == brute(rows, target, width, size)


def test_drawn_rows_and_empty_tables(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents]
    docs, got = found(spark, rows, [], percent=10)
    drawn = {r.doc_id for r in got.where("rank is not null").collect()}
    assert {r.doc_id for r in resampling.resampled(docs, got).collect()} == drawn and len(drawn) == sum(features(t, 1)[1] >= 20 for _, t in rows) * 10 // 100
    assert found(spark, [], ["a b"])[1].count() == 0
    with pytest.raises(ValueError):
        found(spark, rows, [], size=100_000)
