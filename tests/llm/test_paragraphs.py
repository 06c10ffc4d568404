import random
import re

from test_near_dups import sets

from kinweave.llm.common import Scratch
from kinweave.llm.paragraphs import PASSAGE, dedup_paragraphs


def brute(rows, least=25):
    every = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= least:
                every[(d is None, d or 0, t, k)] = sets(line, 5)
    keys = list(every)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(every[a] & every[b])
            if both and 100 * both >= 80 * (len(every[a]) + len(every[b]) - both):
                root[find(a)] = find(b)
    first = {}
    for k in sorted(keys, key=lambda k: (k[0], k[1], k[3])):
        first.setdefault(find(k), k)
    runs, words = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words[d, t] = [(m.start(), re.sub("[A-Z]+", lambda x: x[0].lower(), m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        own = [w for _, w in words[d, t]]
        for i in range(len(own) - PASSAGE + 1):
            runs.setdefault(tuple(own[i : i + PASSAGE]), ((d, t), i))
    out = []
    for d, t in rows:
        gone, at, own = set(), 0, [w for _, w in words[d, t]]
        for k, line in enumerate((t or "").split("\n")):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if (key := (d is None, d or 0, t, k)) in every and first[find(key)] != key:
                gone |= set(range(at, at + n))
            at += n
        for i in range(len(own) - PASSAGE + 1):
            row, k = runs[tuple(own[i : i + PASSAGE])]
            if (row, k) != ((d, t), i):
                gone |= set(range(max(i, k + PASSAGE) if row == (d, t) else i, i + PASSAGE))
        edges = [*(a for a, _ in words[d, t]), len(t or "")]
        text = None if t is None else t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(own)) if k not in gone)
        out.append((d or -1, len(own), len(gone), sum(k - 1 not in gone for k in gone), text))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")
    got = dedup_paragraphs(docs, Scratch(spark, "t")).collect()
    assert sorted(((r.doc_id or -1, r.n_words, r.n_removed, r.n_spans, r.text) for r in got), key=repr) == brute(rows)


def test_families(spark):
    rng = random.Random(1)
    say = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]
    shared = [say(rng.choice([24, 30, 60, 120])) for _ in range(10)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(shared)) if rng.random() < 0.6 else say(rng.randrange(80))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                if line:
                    line[rng.randrange(len(line))] = "z" + str(rng.randrange(99))
            lines.append(" ".join(line))
        rows.append((i + 1, "\n".join(lines)))
    check(spark, rows)


def test_passages_in_longer_lines(spark):
    """A passage of 51 words in lines that differ otherwise, and one over short lines, at any place of both."""
    rng = random.Random(2)
    say = lambda n: [f"v{rng.randrange(100_000)}" for _ in range(n)]
    one, two = say(51), say(60)
    rows = [(k, " ".join([*say(k * 9), *one, *say(70)])) for k in range(1, 5)]
    rows += [(k, "\n".join(" ".join(x[i : i + 9]) for x in [[*say(k), *two, *say(3)]] for i in range(0, len(x), 9))) for k in range(5, 9)]
    check(spark, rows)
    assert [r[2] for r in brute(rows)] == [0, 51, 51, 51, 0, 60, 60, 60]


def test_odd(spark):
    p = " ".join(f"w{i}" for i in range(60))
    check(spark, [(5, p), (5, p), (3, f"{p}\nx\n{p.upper()}\n"), (9, None), (10, ""), (11, f"\n\n{p}"), (12, "k " * 40_000)])
    check(spark, [(1, p + " end"), (2, f"{p}\r\n{p}")])
    check(spark, [])


def test_table(spark, documents):
    check(spark, [(d["doc_id"], d["text"]) for d in documents[:120]])


def test_all_blanks_and_the_sql(spark, tmp_path):
    """Texts with every kind of blank, by the operator and by the SQL of its query."""
    import duckdb

    from kinweave.llm import queries

    rng = random.Random(12)
    blanks = [" ", "\t", "\r\n", "\v", "\f", "\n", " \r ", "\n\n"]
    say = lambda n: "".join(rng.choice("abcdefgh") + str(rng.randrange(90)) + rng.choice(blanks) for _ in range(n))
    passages = [say(70), say(55)]
    rows = [(i, "".join(rng.choice([say(rng.randrange(1, 40)), rng.choice(passages), rng.choice(passages).replace("\r\n", "\f")]) for _ in range(4))) for i in range(12)]
    rows += [(20, "\r\n \v"), (21, rows[0][1].replace("\f", "\r"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_removed, n_spans, text FROM ({queries.OP10_SQL})").fetchall())
    got = queries.op10_paragraph_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "n_spans", "text")
    assert sorted(map(tuple, got.collect())) == want and any(r[2] > 50 for r in want)
