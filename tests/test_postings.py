"""The best targets by pruned lists against all products; the fitted vocabulary; the stored weighted index and runs of it."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kinweave import __main__ as cli
from kinweave.operators import blocking, model, outputs, postings, retrieval, weighted
from kinweave.plans import runs
from kinweave.sources import tables

N = 240
SCHEMA = ", ".join(f"{c} string" for c in tables.FIELDS)


def weights(rng, n, tag, terms=60, much=12):
    return [(f"{tag}{i}", rng.choice("AB"), f"t{t}", rng.choice((0.25, 0.5, 1.0, rng.random()))) for i in range(n) for t in {int(rng.random() ** 3 * terms) for _ in range(rng.randrange(much))}]


def brute(q, t, n):
    lists, scores = defaultdict(list), defaultdict(Counter)
    for i, c, term, w in t:
        lists[c, term].append((i, w))
    for i, c, term, w in q:
        for j, x in lists[c, term]:
            scores[i, c][j] += w * x
    return sorted((i, j, round(s, 6)) for (i, _), found in scores.items() for j, s in sorted(((j, round(s, 9)) for j, s in found.items()), key=lambda x: (-x[1], x[0]))[:n] if s > 0)


@pytest.mark.parametrize("much", [3, 30])
def test_best_targets(spark, much):
    rng = random.Random(much)
    one = lambda rows: list({(i, term): (i, {"A": "A", "B": "B"}[c0], term, w) for (i, _, term, w), c0 in ((r, first[r[0]]) for r in rows)}.values())
    q, t = weights(rng, 60, "q", much=much), weights(rng, 500, "t", much=much)
    first = {}
    for r in q + t:
        first.setdefault(r[0], r[1])
    q, t = one(q), one(t)
    schema = "id string, country_key string, term string, w double"
    a, b = (spark.createDataFrame(rows, schema) for rows in (q, t))
    count = lambda rows: rows.groupBy("country_key").agg({"id": "count"}).toDF("country_key", "n")
    got = postings.best_targets(a, b, 7, count(a.select("id", "country_key").distinct()), count(b.select("id", "country_key").distinct()), shard=90, block=17)
    assert sorted((r.q, r.t, round(r.score, 6)) for r in got.collect()) == brute(q, t, 7)
    nothing = spark.createDataFrame([], schema)
    assert postings.best_targets(a, nothing, 7, count(a), count(nothing)).count() == 0


def test_lists_are_left_unread(monkeypatch):
    """Common terms that cannot lift a new target over the threshold are only looked up."""
    rng = np.random.default_rng(0)
    rows = [(f"d{i:05}", "every", 0.01) for i in range(5000)] + [(f"d{i:05}", f"rare{i % 50}", 1.0 + 0.001 * (i % 7)) for i in range(5000)]
    lists = postings.Lists(pa.table({"id": [r[0] for r in rows], "term": [r[1] for r in rows], "w": [r[2] for r in rows]}))
    read, added = [], postings.Lists.added
    monkeypatch.setattr(postings.Lists, "added", lambda self, total, some, w: read.extend(self.size[some]) or added(self, total, some, w))
    number = {t: i for i, t in enumerate(lists.terms.to_pylist())}
    found, scores = lists.best(np.array([number["every"], number["rare3"]]), np.array([1.0, 1.0]), 10)
    assert max(read) <= 100 and len(found) == 10 and np.allclose(scores, 1.016) and rng is not None


def test_most_frequent_terms(spark):
    rng = random.Random(8)
    rows = [(f"d{i}", c, f"w{int(rng.random() ** 2 * 40)}", rng.randrange(1, 4)) for c in "AB" for i in range(60) for _ in range(2)]
    rows = list({r[:3]: r for r in rows}.values())
    got = retrieval.most_frequent(spark.createDataFrame(rows, "id string, country_key string, term string, tf long"), 9).collect()
    for c in "AB":
        times, df = Counter(), Counter()
        for _, x, term, tf in rows:
            if x == c:
                times[term] += tf
                df[term] += 1
        assert {(r.term, r.df) for r in got if r.country_key == c} == {(t, df[t]) for t in sorted(times, key=lambda t: (-times[t], t))[:9]}


def test_dealing():
    rng = random.Random(2)
    for k in (2, 3, 5):
        for _ in range(60):
            sizes = sorted((rng.choice((1, 1, 2, 3, 7, 40, 195)) for _ in range(rng.randrange(1, 80))), reverse=True)
            loads, want = [0] * k, []
            for s in sizes:
                want.append(loads.index(min(loads)))
                loads[want[-1]] += s
            got = []
            for size, first, cycle in model.dealing(dict(Counter(sizes)), k):
                n = sizes.count(size)
                got += [first[j] if j < len(first) else cycle[(j - len(first)) % k] for j in range(n)]
            assert got == want and max(loads) - min(loads) <= sizes[0]


def test_stored_index(spark, split, tmp_path, monkeypatch):
    queries, targets = tables.load_split(spark, str(split), "test")
    folder, prepared = str(tmp_path / "index"), blocking.prepare(queries)
    fit, calls = retrieval.Method.fit, []

    def failing(self, *a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return fit(self, *a)

    monkeypatch.setattr(retrieval.Method, "fit", failing)
    with pytest.raises(RuntimeError):
        weighted.build(spark, targets, folder)
    with pytest.raises(ValueError):
        weighted.load(spark, folder)
    assert len(weighted.missing_parts(spark, folder)) == 8
    monkeypatch.setattr(retrieval.Method, "fit", fit)
    built = weighted.build(spark, targets, folder)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*")}
    assert weighted.missing_parts(spark, folder) == [] and weighted.build(spark, targets, folder).records.count() == targets.count()
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*")}
    for settings in ({"most": 5}, {"sample": 9}):
        with pytest.raises(ValueError):
            weighted.build(spark, targets, folder, **settings)
    with pytest.raises(ValueError):
        weighted.build(spark, targets.limit(3), folder)
    few = prepared.limit(40).cache()
    key = lambda r: (r.q, r.t, round(r.char_name, 6), round(r.char_address, 6), round(r.bm25, 6), r.retrieval_methods)
    assert sorted(map(key, weighted.retrieve(few, built, 6, 5, 7).collect())) == sorted(map(key, retrieval.retrieve(few, blocking.prepare(targets), 6, 5, 7).collect()))


def test_hybrid_command_line(spark, split, tmp_path, capsys):
    data, work, out = str(split), str(tmp_path / "work"), str(tmp_path / "out")
    assert cli.main(["train", "--path", "hybrid", "--data", data, "--truth", f"{data}/truth.tsv", "--work", work, "--sample", "80", "--trees", "2", "--rate", "0.2", "--folds", "2", "--name-k", "8", "--address-k", "8", "--words-k", "8", "--fit-sample", "300", "--max-features", "3000"]) == 0
    found = runs.read_json(spark, f"{work}/metrics")
    assert found["path"] == "hybrid" and found["link_recall"] > 0.95 and {"char_name_rank", "bm25"} <= set(found["columns"])
    go = ["predict", "--data", data, "--work", work, "--out", out, "--batches", "2"]
    assert cli.main(go) == 0
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert cli.main(go) == 0 and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert not (tmp_path / "out" / "index").exists()  # the targets are those of the training
    for wrong in (["--batches", "3"], ["--part", "2", "--parts", "2"], ["--parts", "0"]):
        with pytest.raises((ValueError, SystemExit)):
            cli.main([*go, *wrong])
    assert cli.main(["merge", "--data", data, "--out", out]) == 0
    assert "batch 2 of 2" in capsys.readouterr().out and outputs.read_result(spark, f"{out}/matches").count() == N
    with pytest.raises(ValueError):
        runs.train(spark, *tables.load_split(spark, data, "train"), tables.read_tsv(spark, f"{data}/truth.tsv"), work, path="hybrid", cap=3)


def test_other_targets_get_an_index_of_their_own(spark, split, tmp_path):
    data, work, out = str(split), str(tmp_path / "work"), str(tmp_path / "out")
    queries, targets = tables.load_split(spark, data, "train")
    runs.train(spark, queries, targets, tables.read_tsv(spark, f"{data}/truth.tsv"), work, 80, 2, 1)
    other = targets.where("entity_id NOT LIKE '%7'")
    runs.predict(spark, queries.limit(20), work, out, targets=other)
    assert (tmp_path / "out" / "index").exists()
    lists = spark.read.parquet(f"{out}/part=0/batch=0").collect()
    assert len(lists) == 20 and not any(x.endswith("7") for r in lists for x in r.candidate_entity_ids.split(","))
    with pytest.raises(ValueError):
        runs.predict(spark, queries.limit(19), work, out, targets=other)
    assert spark.createDataFrame([], SCHEMA).count() == 0


def test_shards_are_read_once(spark):
    """A record is one row; a group's targets stand before its queries, which come in any number of batches and are never held together."""
    rng, names = random.Random(5), ["country_key", "shard", "block", "asks", "id", "term", "w"]
    sides = [[(f"{tag}{i:03}", {t: rng.random() for t in rng.sample(range(40), 6)}) for i in range(n)] for tag, n in (("t", 90), ("q", 30))]
    rows = [("A", 0, block, asks, i, list(x), list(x.values())) for block in (0, 1) for asks in (False, True) for i, x in sides[asks]]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    got = pa.Table.from_batches(postings.best_of_shards(iter(table.to_batches(max_chunksize=7)), 5)).to_pylist()
    want = brute(*([(i, "A", t, w) for i, x in sides[s] for t, w in x.items()] for s in (1, 0)), 5)
    assert sorted((r["q"], r["t"], round(r["score"], 6)) for r in got) == sorted(want * 2)
    long = spark.createDataFrame([("a", "A", "x", 1.0), ("a", "A", "y", 2.0), ("b", "A", "x", 3.0)], "id string, country_key string, term string, w double")
    assert {(r.id, len(r.term), sum(r.w)) for r in postings.packed(long).collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
    records = spark.createDataFrame([("a", "A", "x yy x x"), ("b", "A", ""), ("c", "A", None)], "entity_id string, country_key string, name string")
    counts = retrieval.term_counts(records, retrieval.tokens(retrieval.F.col("name")))
    assert sorted((r.id, r.term, r.tf) for r in counts.collect()) == [("a", "x", 3), ("a", "yy", 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
