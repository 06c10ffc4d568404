import random
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import substrings
from kinweave.llm.common import Scratch
from kinweave.llm.substrings import remove_repeats, repeated_strings


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((doc if doc is not None else -1, len(d), kept, int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum())))
    return sorted(out)


def check(spark, rows, length=200, gram=64):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int")
    got = remove_repeats(docs, Scratch(spark, "t"), length, gram).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, bytes(r.kept), sum(s.stop - s.start for s in r.removed), len(r.removed)) for r in got) == brute(rows, length)


@pytest.mark.parametrize("seed", range(4))
def test_transform(seed):
    rng = random.Random(seed)
    core = bytes(rng.choice(b"ab\0\xff") for _ in range(60))
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(30))) + core[rng.randrange(20) : 20 + rng.randrange(40)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(40)]
    parts = list(dict.fromkeys(p for p in parts if len(p) >= 12))
    weights = np.array([rng.choice([1, 1, 1, 2]) for _ in parts])
    count = Counter()
    for p, w in zip(parts, weights, strict=True):
        for i in range(len(p) - 11):
            count[p[i : i + 12]] += w
    want = [[i for i in range(len(p) - 11) if count[p[i : i + 12]] > 1] for p in parts]
    assert [x.tolist() for x in repeated_strings(parts, weights, 12)] == want


def mixed(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeéstn") for _ in range(rng.randrange(1, 8)))
    say = lambda k: " ".join(word() for _ in range(k))
    lines = [say(rng.choice([5, 20, 60])) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([say(rng.randrange(60)), rng.choice(lines), rng.choice(lines)[3:-2]]) for _ in range(rng.randrange(8)))) for i in range(n)]
    return rows + [(900, rows[3][1]), (901, rows[5][1][: len(rows[5][1]) // 2]), (902, "a" * 700), (903, "ab" * 150), (904, "ab" * 99), (905, "xy" + "a" * 205 + "z")]


@pytest.mark.parametrize("groups", [3000, 2])
def test_texts(spark, groups, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_SEGMENTS", groups)
    monkeypatch.setattr(substrings, "SLICE", 1500)
    monkeypatch.setattr(substrings, "BATCH", 5000)
    check(spark, mixed(1, 60))
    check(spark, mixed(2, 60), 100, 32)


def test_odd(spark):
    check(spark, [(1, None), (2, ""), (None, "x" * 199), (4, "y" * 200), (4, "y" * 200), (6, "".join(map(chr, range(300, 500))))])
    check(spark, [])


def test_table(spark, documents):
    check(spark, [(d["doc_id"], d["text"]) for d in documents])
