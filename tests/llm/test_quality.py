import zlib

import numpy as np

from kinweave.llm.quality import grow, score_quality, statistics

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if got[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    good = [got[d].predicted for d in held if truth[d] == 1]
    bad = [got[d].predicted for d in held if truth[d] == 0]
    assert len(bad) > 50 and np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_odd_rows(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (None, None, 1), (4, "", 1), (5, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (1, None), (None, 0), (4, 0), (5, 1)], "doc_id long, quality int")):
        got = score_quality(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert score_quality(docs.limit(0), none).count() == 0


def test_forest_learns_a_step():
    x = np.random.default_rng(0).random((2000, 26))
    y = ((x[:, 3] > 0.5) ^ (x[:, 5] > 0.3)).astype(float)
    assert (np.round(grow(x, y).score(x)) == y).mean() > 0.97
    assert statistics([""]).shape == (1, 26) and not statistics([""]).any()
