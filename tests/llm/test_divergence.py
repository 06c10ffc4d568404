"""The audit against a plain one, with few and many blocks of sources."""

import re
from collections import Counter, defaultdict

from kinweave.llm import divergence
from kinweave.llm.common import Scratch

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r[:3]) for r in rows]
    docs, times, groups = Counter(), defaultdict(Counter), sorted({r[:2] for r in rows})
    for lang, source, text in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text)]
        times[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (x, t), n in docs.items() if x == lang and n >= least], [s for x, s in groups if x == lang]

        def shares(n, kept=kept):
            whole = sum(n[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1000000000 * (n[t] + 5) // whole for t in kept}

        of, q = {s: shares(times[lang, s]) for s in sources}, shares(sum((times[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - of[s][t], t) for t in kept if times[lang, s][t] and of[s][t] > q[t]]
            for part, items, n in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:n], 1)]
    return sorted(out)


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 13)
    monkeypatch.setattr(divergence, "HELD", 500)
    monkeypatch.setattr(divergence, "PIECE", 1000)
    monkeypatch.setattr(divergence, "CELLS", 30)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    rows += [(None, None, "the The DE"), (None, "x", None), ("en", "new", ""), ("en", "src1", "the word " * 3000 + "日本 été"), ("zz", "only", "one"), ("en", None, "the 𝄞 ａ")] * 2
    frame = spark.createDataFrame([(*r, *"abcdef") for r in rows], "lang string, source string, text string, first string, term string, vec string, gid string, n string, item string")
    got = divergence.divergence_audit(frame, Scratch(spark, "t"), 6, 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 4)


def test_no_rows_and_no_terms(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergence_audit(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
    rows = [("a", "x", "b c"), ("a", "y", None), ("b", "x", "")]
    got = divergence.divergence_audit(spark.createDataFrame(rows, schema), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect())) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
