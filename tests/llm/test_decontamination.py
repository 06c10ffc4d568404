import random
import re

import pytest

from kinweave.llm.common import Scratch
from kinweave.llm.decontamination import contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in rows:
        w, hit, got = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    got |= windows[tuple(w[i : i + k])]
        out.append((doc or -1, len(w), len(hit), len(got), ",".join(sorted(got)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def check(spark, rows, items):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rk int")
    got = contamination(docs, bench, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == brute(rows, items)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    few = lambda n: " ".join(rng.choice(["a", "B", "b", "É", "é", "x1"]) for _ in range(n))
    items = [(i, few(rng.choice([0, 1, 5, 12, 13, 14, 20, 30]) if i < 6 else 25)) for i in range(8)] if seed else [(i, few(25)) for i in range(3)]
    rows = [(i, few(rng.randrange(300)).replace(" ", rng.choice([" ", ", ", "\n"]))) for i in range(25)]
    rows += [(100 + i, "q " * 20 + t + " z" * rng.choice([0, 900])) for i, t in items]
    check(spark, rows, items)


def test_odd(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, long), (1, long), (None, None), (3, ""), (4, "x " * 50_000 + long.upper()), (5, "w1 w2")]
    check(spark, rows, [(7, long), (7, long), (10, long), (None, "w1 w2"), (8, None), (9, "")])
    check(spark, rows, [])
    check(spark, [], [(7, long)])


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    get = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()]
    check(spark, get("documents", "doc_id"), get("benchmark", "item_id"))
