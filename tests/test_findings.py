"""Findings of many rows."""

from pyspark.sql import functions as F

from kinweave.operators import outputs


def test_findings_read_their_rows_few_times(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9"), ("S1-1", None), ("S1-3", "X7, ,S3-1"), (None, "S2-5")], "source1_entity_id string, ids string")
    required, known = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string"), spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    counted = outputs.findings(rows, "ids", required, known)
    expected = {rule: broken.count() for rule, broken in outputs.broken_rules(rows, "ids", required, known).items()}
    assert {r.rule: r.n for r in counted.collect()} == expected
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 5  # three times the rows, once each of the ids; it was a pass a rule
    empty = outputs.findings(rows.where(F.lit(False)), "ids", required.where(F.lit(False)), known)
    assert {r.n for r in empty.collect()} == {0} and empty.count() == 7
