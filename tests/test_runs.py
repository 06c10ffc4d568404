import time

import pytest
from pyspark.sql import functions as F

from kinweave import __main__ as cli
from kinweave.operators import blocking, index, outputs
from kinweave.plans import runs
from kinweave.sources import tables
from kinweave.streaming import incremental

N = 240
SCHEMA = ", ".join(f"{c} string" for c in tables.FIELDS)
TARGETS = [("S2-1", "Alpha Bakery", "12 Main Street", "India"), ("S3-1", "Alpha Bakery", "12 Main Street", "France"), ("S2-2", "Beta Cafe", "17 Park Road", "India")]


def test_index(spark, tmp_path, monkeypatch):
    folder, targets = str(tmp_path / "index"), spark.createDataFrame(TARGETS, SCHEMA)
    blocks = blocking.blocking_keys
    calls = []

    def failing(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return blocks(rows)

    monkeypatch.setattr(blocking, "blocking_keys", failing)
    with pytest.raises(RuntimeError):
        index.build(spark, targets, folder, shards=4)
    assert len(index.missing_shards(spark, folder, 4)) == 2
    with pytest.raises(ValueError):
        index.load(spark, folder)
    monkeypatch.setattr(blocking, "blocking_keys", blocks)
    built = index.build(spark, targets, folder)
    assert index.manifest(spark, folder)["shards"] == 4 and index.missing_shards(spark, folder, 4) == [] and built.records.count() == 3
    query = blocking.prepare(spark.createDataFrame([("S1-1", "Alpha Bakery", "12 Main St", "india")], SCHEMA))
    assert [r.t for r in index.retrieve(query, built).collect()] == ["S2-1"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*")}
    assert index.build(spark, targets.orderBy(F.desc("entity_id")), folder).records.count() == 3
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*")}
    stored = index.load(spark, folder)
    assert sorted(map(tuple, stored.usable.collect())) == sorted(map(tuple, index.in_plan(blocking.prepare(targets)).usable.select("entity_id", "key").collect()))
    for changed in (targets.limit(2), targets.withColumn("country", F.lit("x"))):
        with pytest.raises(ValueError):
            index.build(spark, changed, folder)
    with pytest.raises(ValueError):
        index.build(spark, targets, folder, cap=7)
    with pytest.raises(ValueError):
        index.build(spark, targets.union(targets), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_command_line(spark, split, tmp_path, capsys):
    data, work, out = str(split), str(tmp_path / "work"), str(tmp_path / "out")
    assert cli.main(["train", "--data", data, "--truth", f"{data}/truth.tsv", "--work", work, "--sample", "200", "--trees", "8", "--rate", "0.15"]) == 0
    found = runs.read_json(spark, f"{work}/metrics")
    assert found["queries"] == 200 and found["link_recall"] == 1 and found["macro_fbeta"] > 0.9 and found["folds"] == 3
    assert spark.read.csv(f"{work}/thresholds", header=True).count() == 131
    with pytest.raises(ValueError):
        index.build(spark, spark.createDataFrame(TARGETS, SCHEMA), f"{work}/index")
    for part in (0, 1):
        if part:
            with pytest.raises(ValueError):
                cli.main(["merge", "--data", data, "--out", out])
        assert cli.main(["predict", "--data", data, "--work", work, "--out", out, "--part", str(part), "--parts", "2"]) == 0
    with pytest.raises(ValueError):
        cli.main(["predict", "--data", data, "--work", work, "--out", out, "--part", "0", "--parts", "3"])
    assert cli.main(["merge", "--data", data, "--out", out]) == 0
    assert cli.main(["validate", "--data", data, "--matches", f"{out}/matches", "--candidates", f"{out}/candidates"]) == 0
    assert cli.main(["benchmark", "--data", data, "--work", work, "--queries", "10"]) == 0
    said = capsys.readouterr().out
    assert "queries_a_second" in said and "error" not in said
    ids = [r.source1_entity_id for r in outputs.read_result(spark, f"{out}/matches").collect()]
    assert ids == sorted(ids) and len(ids) == N


def test_warnings_and_unreadable_files(spark, split, tmp_path):
    queries, targets = tables.load_split(spark, str(split), "test")
    good = tmp_path / "m.tsv"
    good.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t\n" for i in range(N)))
    errors, warnings = outputs.validate(spark, str(good), None, queries)
    assert errors == [] and len(warnings) == 2
    (tmp_path / "bad.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\xfe\n")
    assert outputs.validate_file(spark, str(tmp_path / "bad.tsv"), outputs.MATCHES, queries) == ["the file is not UTF-8"]
    assert "can't be read" in outputs.validate_file(spark, str(tmp_path / "none.tsv"), outputs.MATCHES, queries)[0]
    many = tmp_path / "many.tsv"
    many.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tX{i}\n" for i in range(N)))
    message = next(m for m in outputs.validate_file(spark, str(many), outputs.MATCHES, queries, targets) if m.startswith("bad_prefix"))
    assert message == f"bad_prefix: {N}, as X0, X1, X10, X100, X101"
    lost = tmp_path / "c.tsv"
    lost.write_text("source1_entity_id\tcandidate_entity_ids\n" + "".join(f"S1-{i}\t\n" for i in range(N)))
    good.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{'S2-1' if i == 1 else ''}\n" for i in range(N)))
    assert outputs.validate(spark, str(good), str(lost), queries, targets)[0] == ["1 matches are no candidates, as S2-1"]


def test_sample(spark):
    queries = spark.createDataFrame([(f"S1-{i}", "a", "b", "c") for i in range(9)], SCHEMA)
    truth = spark.createDataFrame([(f"S1-{i}", "") for i in range(5, 20)], "source1_entity_id string, matched_entity_ids string")
    chosen, known = runs.sample_labelled(queries, truth, 3)
    ids = {r.entity_id for r in chosen.collect()}
    assert len(ids) == 3 and ids <= {f"S1-{i}" for i in range(5, 9)} and {r.source1_entity_id for r in known.collect()} == ids


def test_fingerprint_of_files(spark, tmp_path):
    for name, text in (("a", "x"), ("b", "y")):
        (tmp_path / name).write_text(text)
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    one = tables.file_fingerprint(spark, both)
    assert one == tables.file_fingerprint(spark, both[::-1]) != tables.file_fingerprint(spark, both[:1])
    (tmp_path / "b").write_text("z")
    assert one != tables.file_fingerprint(spark, both)


def test_fingerprint_is_the_same_for_all_ranges(spark, tmp_path):
    lines = [f"line {i}\tü{i * i}" for i in range(4000)]
    path, usual = tmp_path / "rows.tsv", spark.conf.get("spark.sql.files.maxPartitionBytes")
    path.write_text("\r\n".join(lines) + "\n\n")
    (tmp_path / "empty").write_text("")
    found = set()
    try:
        for size in (usual, "1000", "7777", "30k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.add(tables.file_fingerprint(spark, [str(path), str(tmp_path / "empty")]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert len(found) == 1
    for other in (lines[::-1], lines[:-1] + [lines[-1] + " "]):
        path.write_text("\r\n".join(other) + "\n\n")
        assert tables.file_fingerprint(spark, [str(path), str(tmp_path / "empty")]) not in found
    path.write_text("\r\n".join(lines) + "\n")  # a line break less
    assert tables.file_fingerprint(spark, [str(path), str(tmp_path / "empty")]) not in found


def test_progress(spark, tmp_path):
    said, targets = [], spark.createDataFrame(TARGETS, SCHEMA)
    spark.createDataFrame([("S1-1", "Alpha Bakery", "12 Main St", "india"), ("S1-2", "b", "c", "d")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    listener = incremental.Progress(said.append, 4)
    spark.streams.addListener(listener)
    try:
        incremental.run(spark, str(tmp_path / "in"), targets, str(tmp_path / "out"))
        for _ in range(100):
            if said:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert said and said[0].startswith("batch 0: 2 queries") and said[0].endswith("s left")
