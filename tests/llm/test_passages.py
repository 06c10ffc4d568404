import random
import re

import corpus_pipeline
import pytest

from kinweave.llm.common import Scratch
from kinweave.llm.paragraphs import drop_passages
from kinweave.llm.passages import WIDTH


def brute(rows):
    first, words = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words[d, t] = [(m.start(), re.sub("[A-Z]+", lambda x: x[0].lower(), m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        own = [w for _, w in words[d, t]]
        for i in range(len(own) - WIDTH + 1):
            first.setdefault(tuple(own[i : i + WIDTH]), ((d, t), i))
    out = []
    for d, t in rows:
        own, gone = [w for _, w in words[d, t]], set()
        for i in range(len(own) - WIDTH + 1):
            row, k = first[tuple(own[i : i + WIDTH])]
            if (row, k) != ((d, t), i):
                gone |= set(range(max(i, k + WIDTH) if row == (d, t) else i, i + WIDTH))
        starts = [s for s, _ in words[d, t]]
        edges = [*starts, len(t or "")]
        out.append((d, None if t is None else t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(starts)) if k not in gone)))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, x int")
    got = drop_passages(docs, Scratch(spark, "t"))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(rows)


@pytest.fixture(scope="module")
def wrapped():
    rng = random.Random(5)
    say = lambda n: [rng.choice("abcé") + str(rng.randrange(10_000)) for _ in range(n)]
    shared = [say(n) for n in (49, 50, 51, 52, 75, 130)]
    rows = []
    for i in range(80):
        words = [w for _ in range(rng.randrange(1, 4)) for w in [*say(rng.randrange(60)), *(rng.choice(shared) if rng.random() < 0.7 else [])]]
        rows.append((i + 1, "".join(w.upper() + "\n" if rng.random() < 0.1 else w + rng.choice([" ", "  ", "\t", " \n"]) for w in words)))
    return rows


def test_passages(spark, wrapped):
    check(spark, wrapped)


def test_odd(spark):
    p = " ".join(f"w{i}" for i in range(51))
    check(spark, [(5, p), (5, p), (3, f"x\n{p.upper()}\n{p}"), (9, None), (10, ""), (None, f"é {p} é"), (12, "k " * 4_000), (13, "a b " * 60 + "c"), (14, p[:-4])])
    check(spark, [])


def test_stage(spark):
    """Lines of under 25 words, and a passage within longer lines that differ otherwise."""
    rng = random.Random(6)
    say = lambda n: [f"v{rng.randrange(100_000)}" for _ in range(n)]
    one, two = say(60), say(60)
    rows = [(1, "\n".join(" ".join(one[i : i + 12]) for i in range(0, 60, 12))), (2, "\n".join(" ".join(["top", *one, "end"][i : i + 9]) for i in range(0, 62, 9)))]
    rows += [(k, " ".join([*say(70), *two, *say(70)])) for k in (3, 4)]
    got = corpus_pipeline.drop_repeated_paragraphs(spark, spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long"), "")
    got = {r.doc_id: r for r in got.collect()}
    assert got[1].text == rows[0][1] and got[2].text.split() == ["top", "end"] and got[3].text == rows[2][1]
    assert len(got[4].text.split()) == 140 and all(r.n_chars == len(r.text) for r in got.values())
