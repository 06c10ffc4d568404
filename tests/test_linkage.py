import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.operators import blocking, features, metrics, model, outputs, retrieval
from kinweave.plans import linkage, oracle
from kinweave.sources import tables
from kinweave.streaming import incremental

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tables.FIELDS))


BAKERY = [("S2-1", "Alpha Bakery", "12 High Street", "IN"), ("S2-2", "Beta Bakery", "90 Low Street", "IN"), ("S3-1", "Alpha Bakery", "12 High Street", "IN"), ("S3-2", "Gamma Bank", "4 Park Road", "IN")]
QUERIES = [("S1-1", "Alpha Bakery", "12 High Street", "in"), ("S1-2", "Beta Bakery", "90 Low Street", "IN")]


@pytest.mark.parametrize(
    "text,normal,latin",
    [(None, "", ""), ("NaN", "", ""), (" Null ", "", ""), ("A & B", "a and b", "a and b"), ("https://www.x.de/a_b", "x de a_b", "x de a_b"), ("Éàß Œuvre", "éàß œuvre", "eass oeuvre"), ("a\t\n b--c", "a b c", "a b c")],
)
def test_normalization(spark, text, normal, latin):
    row = spark.createDataFrame([(text,)], "x string").select(T.normalize_text(F.col("x")).alias("n"), T.normalize_latin(F.col("x")).alias("l")).first()
    assert (row.n, row.l) == (normal, latin)


def test_names_and_addresses(spark):
    rows = [("Alpha Bakery Ltd", "12 Main Road, Madhya Pradesh"), ("LLC", "roadside 5 Floor"), ("ﬁrm", "x")]
    got = spark.createDataFrame(rows, "n string, a string").select(T.core_name(T.normalize_latin(F.col("n"))).alias("n"), T.normalize_address(F.col("a")).alias("a"), T.nfkc(F.col("n")).alias("k")).collect()
    assert [(r.n, r.a) for r in got[:2]] == [("alpha bakery", "12 main rd mp"), ("", "roadside 5 fl")] and got[2].k == "firm"


def test_indian_scripts(spark):
    """Nine scripts by one table; letters with dots, whole or in parts, conjuncts, digits, and the vowel that northern scripts drop at the end."""
    words = {
        "राम": "ram", "दिल्ली": "dilli", "मुंबई": "munbai", "कंपनी प्राइवेट": "kanpani praivet", "लक्ष्मी": "lakshmi", "ज़मीन": "zamin", "\u095bमीन": "zamin", "पढ़ाई": "parhai", "कृष्ण १२": "krishn 12", "क": "ka", "सड़क": "sarak",
        "বাংলা": "banla", "ગુજરાત": "gujarat", "ਪੰਜਾਬ": "panjab", "தமிழ்": "tamil", "తెలుగు": "telugu", "ಕನ್ನಡ": "kannada", "കേരളം": "keralan", "Café राम": "cafe ram", "": "",
    }
    got = spark.createDataFrame([(w,) for w in words], "x string").select("x", T.normalize_latin(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == words


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def test_similarities():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randrange(12))) for _ in "ab")
        assert S.lcs(a, b) == plain_lcs(a, b)
        if a or b:
            assert math.isclose(S.jaro_winkler(a, b), duckdb.sql(f"SELECT jaro_winkler_similarity('{a}', '{b}')").fetchall()[0][0], abs_tol=1e-12) or "é" in a + b
        for f in (S.ratio, S.token_sort, S.token_set, S.partial, S.wratio, S.jaro_winkler):
            assert 0 <= f(a, b) <= 1
    assert S.ratio("", "") == 1 and S.ratio("a", "") == 0 and S.token_set("a b", "b a c") == 1 and S.token_set("", "a") == 0 and S.wratio("", "") == 0
    assert S.partial("bc", "abcd") == 1 and S.token_sort("b a", "a b") == 1 and S.wratio("same", "same") == 1


def test_keys(spark):
    rows = blocking.prepare(frame(spark, [("a", "Alpha Bakery Ltd", "12 Main Road", "INDIA"), ("b", "Alpha Bakery", "12 Main Rd", "india"), ("c", "", "", "India"), ("d", "Alpha Bakery", "12 Main Rd", "France")]))
    keys = {}
    for r in blocking.blocking_keys(rows).collect():
        keys.setdefault(r.entity_id, set()).add(r.key)
    assert keys["a"] == keys["b"] and "c" not in keys and not keys["a"] & keys["d"] and max(map(len, keys.values())) <= 28


@pytest.mark.parametrize("path", [blocking.retrieve, retrieval.retrieve])
def test_bakery(spark, path):
    q, t = blocking.prepare(frame(spark, QUERIES)), blocking.prepare(frame(spark, BAKERY))
    pairs = path(q, t)
    got = {(r.q, r.t) for r in pairs.collect()}
    assert {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")} <= got
    rows = features.rank_features(features.pair_features(pairs, q, t))
    for r in rows.collect():
        assert all(math.isfinite(r[c]) for c in features.model_columns(rows))
    assert path(q, blocking.prepare(frame(spark, [("S2-1", "", "", "IN")]))).count() == 0
    assert path(blocking.prepare(frame(spark, [("S1-9", "a", "", "XX")])), t).count() == 0


def test_one_per_method(spark):
    q, t = blocking.prepare(frame(spark, QUERIES)), blocking.prepare(frame(spark, BAKERY))
    assert all(r["count"] <= 3 for r in retrieval.retrieve(q, t, 1, 1, 1).groupBy("q").count().collect())
    with pytest.raises(ValueError):
        retrieval.retrieve(q, t, 0)


@pytest.mark.parametrize("n,kept", [(256, 256), (257, 0)])
def test_broad_blocks_are_left_out(spark, n, kept):
    keys = spark.range(n).select(F.format_string("S2-%s", "id").alias("entity_id"), F.lit("k").alias("key"))
    assert blocking.usable_blocks(keys).count() == kept


def test_metrics(spark):
    truth = spark.createDataFrame([("S1-1", "S2-00047,S3-00812"), ("S1-2", ""), ("S1-3", "S2-1"), ("S1-4", "")], "source1_entity_id string, matched_entity_ids string")
    links = tables.truth_links(truth)
    one = truth.where("source1_entity_id = 'S1-1'")
    p = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S2-00193"), ("S1-1", "S3-00812"), ("S1-2", "S2-9"), ("S1-99", "S2-1")], "q string, t string")
    assert round(metrics.macro_fbeta(p, one, links.where("source1_entity_id = 'S1-1'")).first()[0], 3) == 0.714
    assert math.isclose(metrics.macro_fbeta(p, truth, links).first()[0], (5 / 7 + 0 + 0 + 1) / 4, abs_tol=1e-9)
    scored = p.withColumn("probability", F.when(F.col("t") == "S2-00193", 0.2).otherwise(F.lit(0.8)))
    for r in metrics.threshold_sweep(scored, truth, links).collect():
        want = metrics.macro_fbeta(scored.where(F.col("probability") >= r.threshold), truth, links).first()[0] if r.threshold in (metrics.GRID[0], metrics.GRID[20], metrics.GRID[-1]) else r.macro_fbeta
        assert math.isclose(r.macro_fbeta, want, abs_tol=1e-9)
    assert len(metrics.GRID) == 131 and metrics.GRID[71] == 0.8099999999999999
    r = metrics.candidate_recall(p, truth, links).first()
    assert (r.captured, r.total, r.entity_recall) == (2, 3, 0.75)


def test_validation(spark, tmp_path):
    required = frame(spark, [(f"S1-{i}", "", "", "") for i in (1, 2, 3)])
    known = frame(spark, BAKERY)

    def messages(text):
        (tmp_path / "f.tsv").write_text(text)
        return outputs.validate_file(spark, str(tmp_path / "f.tsv"), outputs.MATCHES, required, known)

    head = "source1_entity_id\tmatched_entity_ids\n"
    assert messages(head + "S1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-2\n") == []
    assert messages("") == ["the file is empty"] and "commas" in messages("source1_entity_id,matched_entity_ids\n")[0] and "header" in messages("a\tb\n")[0]
    bad = messages(head + "S1-1\tS2-1,S2-1\nS1-1\tS1-2\nS1-2\tX\nS1-9\tS2-77\nnothing\n")
    assert {m.split(":")[0] for m in bad} == {"no tab", "duplicate_row", "repeated_id", "reference_id", "bad_prefix", "missing_row", "extra_row", "unknown_id"}


def test_files(spark, tmp_path):
    (tmp_path / "x_source1.tsv").write_text("﻿entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA\t\tIN\n", encoding="utf-8")
    for i in (2, 3):
        (tmp_path / f"x_source{i}.tsv").write_text(f'entity_id\tbusiness_name\tbusiness_address\tcountry\nS{i}-1\t"A ""B"""\tx\tIN\n')
    one, rest = tables.load_split(spark, str(tmp_path), "x")
    assert [tuple(r) for r in one.collect()] == [("S1-1", "A", "", "IN")] and rest.count() == 2 and rest.first().business_name == 'A "B"'
    assert tables.fingerprint(rest) == tables.fingerprint(rest.orderBy(F.desc("entity_id"))) != tables.fingerprint(one)
    with pytest.raises(ValueError):
        tables.checked(rest.union(rest))
    lists = outputs.id_lists(one, spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1")], "q string, t string"), "matched_entity_ids")
    outputs.write_tsv(lists, str(tmp_path / "out"), single=True)
    assert outputs.validate_file(spark, str(tmp_path / "out"), outputs.MATCHES, one, rest) == []
    assert tables.read_ids(spark, str(tmp_path / "out")).count() == 1


def test_stream(spark, tmp_path):
    t = blocking.prepare(frame(spark, BAKERY))
    folder, incoming = str(tmp_path / "run"), str(tmp_path / "in")
    frame(spark, QUERIES[:1]).write.parquet(incoming)
    incremental.run(spark, incoming, t, folder)
    frame(spark, QUERIES[1:]).write.mode("append").parquet(incoming)
    incremental.run(spark, incoming, t, folder)
    incremental.run(spark, incoming, t, folder)
    got = {r.source1_entity_id: r.matched_entity_ids for r in spark.read.parquet(f"{folder}/results").collect()}
    assert got["S1-1"].split(",")[:1] == ["S2-1"] and len(got) == 2
    with pytest.raises(ValueError):
        incremental.run(spark, incoming, t, folder, threshold=0.9)
    with pytest.raises(ValueError):
        incremental.run(spark, incoming, t.where("entity_id <> 'S3-2'"), folder)
    parts = spark.read.parquet(f"{folder}/results").drop("batch")
    assert outputs.merge_parts(parts, frame(spark, QUERIES)).count() == 2
    for broken in (parts.union(parts), parts.limit(1)):
        with pytest.raises(ValueError):
            outputs.merge_parts(broken, frame(spark, QUERIES))


def test_model(spark, tmp_path):
    w = linkage.World(spark, "/root/testdata/sf0.01")
    rows = metrics.labels(w.set_features(), w.links).cache()
    columns = [c for c in features.model_columns(rows) if c != "votes"]
    models, scored = model.cross_validate(rows, columns, 2, trees=3)
    assert scored.count() == rows.count() and scored.where("probability < 0 or probability > 1").count() == 0
    model.save(models, str(tmp_path / "m"), {"cap": 32})
    loaded, manifest = model.load(spark, str(tmp_path / "m"), {"cap": 32})
    assert manifest["folds"] == 2
    a, b = (model.ensemble(m, rows.limit(20).cache()).agg(F.sum("probability")).first()[0] for m in (models, loaded))
    assert math.isclose(a, b, abs_tol=1e-9)
    with pytest.raises(ValueError):
        model.load(spark, str(tmp_path / "m"), {"cap": 1})
    with pytest.raises(ValueError):
        model.cross_validate(rows.where("label = 0"), columns)


def test_oracle(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    for name in ("linear_match", "char_tfidf_topk", "bm25_topk", "method_union", "pair_jaro_winkler", "threshold_sweep", "validator_findings", "fitted_vocabulary", "bounded_bm25_topk", "balanced_folds", "indic_names"):
        rows, want = linkage.QUERIES[name](spark, SF), con.sql(oracle.ORACLE_SQL[name])
        assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in rows.collect()))) == sorted(map(repr, want.fetchall())), name
