import random
import re

import pytest

from kinweave.llm.common import Scratch
from kinweave.llm.near_dups import near_duplicates
from kinweave.llm.shingles import shingle


def sets(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=3, up=85, down=100):
    s = [sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and down * both >= up * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), 1 << 60 if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)]
        c = None if c == 1 << 60 else c
        out.append((d if d is not None else -1, len(s[i]), c if c is not None else -1, d == c))
    return sorted(out)


def check(spark, rows, width=3, up=85, down=100, symbols=32):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, sh int")
    got = near_duplicates(docs, Scratch(spark, "t"), width, (up, down), symbols).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.doc_id), r.n_shingles, none(r.component_id), r.kept) for r in got) == brute(rows, width, up, down)


def test_shingles(texts):
    for width in (3, 5):
        got = shingle(texts, width)
        for i, t in enumerate(texts):
            assert len(got.of(i)) == len(sets(t, width)), t
    assert list(shingle(["a b", "a  B\n", "b a", "ab"], 3).set_hash()[:2]) == [shingle(["A b"], 3).set_hash()[0]] * 2


@pytest.mark.parametrize("width,up,down,symbols", [(3, 85, 100, 32), (5, 80, 100, 48)])
def test_families(spark, width, up, down, symbols):
    rng = random.Random(width)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(150)]
        for k in range(30):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    check(spark, rows, width, up, down, symbols)


def test_odd(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A  b\nc d"), (None, "a b c d"), (None, None), (7, ""), (8, " \n"), (9, "one"), (2, "ONE"), (1, "one two"), (4, "x y " * 30_000), (None, "q r s t")]
    check(spark, rows)
    check(spark, [])


def test_table(spark, documents):
    check(spark, [(d["doc_id"], d["text"]) for d in documents])
