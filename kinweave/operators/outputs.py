"""Result files and their validation."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5
MATCHES, CANDIDATES = ["source1_entity_id", "matched_entity_ids"], ["source1_entity_id", "candidate_entity_ids"]


def id_lists(queries: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """A row for each query, with the sorted ids of its pairs(q, t), '' without any."""
    lists = pairs.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias(column))
    ids = queries.select(F.col("entity_id").alias("source1_entity_id"))
    return ids.join(lists, ids.source1_entity_id == lists.q, "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def write_tsv(rows: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated text with a header; Spark commits it whole. A single file is for results of a bounded size only."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def broken_rules(rows: DataFrame, column: str, required: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """What breaks each rule, as (what), of rows(source1_entity_id, <ids>); required(entity_id), known(entity_id)."""
    ids = rows.select("source1_entity_id", F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x) != "").alias("ids"))
    each = ids.select("source1_entity_id", F.explode("ids").alias("id"))
    seen, wanted = rows.select("source1_entity_id").distinct(), required.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    rules = {
        "duplicate_row": ids.groupBy("source1_entity_id").agg(F.count("*").alias("n")).where("n > 1"),
        "repeated_id": ids.where(F.size("ids") != F.size(F.array_distinct("ids"))),
        "reference_id": each.where(F.col("id").startswith("S1-")).select("id"),
        "bad_prefix": each.where(~F.substring("id", 1, 3).isin("S1-", "S2-", "S3-")).select("id"),
        "missing_row": wanted.join(seen, "source1_entity_id", "left_anti"),
        "extra_row": seen.join(wanted, "source1_entity_id", "left_anti"),
    }
    if known is not None:
        rules["unknown_id"] = each.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")
    return {rule: broken.select(F.col(broken.columns[0]).alias("what")) for rule, broken in rules.items()}


def findings(rows: DataFrame, column: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n): how often each rule of broken_rules is broken; lists are looked at in place, and an unknown id is looked up once for all its uses."""
    ids = rows.select("source1_entity_id", F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x) != "").alias("ids"))
    count = lambda condition: F.size(F.filter("ids", condition)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    inside = ids.agg(
        F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("repeated_id"), total(count(lambda x: x.startswith("S1-"))).alias("reference_id"),
        total(count(lambda x: ~F.substring(x, 1, 3).isin("S1-", "S2-", "S3-"))).alias("bad_prefix"),
    )
    seen = rows.groupBy("source1_entity_id").agg(F.count("*").alias("n"))
    wanted = required.select(F.col("entity_id").alias("source1_entity_id"), F.lit(True).alias("wanted")).distinct()
    heads = seen.join(wanted, "source1_entity_id", "full").agg(F.count_if(F.col("n") > 1).alias("duplicate_row"), F.count_if(F.col("n").isNull()).alias("missing_row"), F.count_if(F.col("wanted").isNull()).alias("extra_row"))
    out, rules = heads.crossJoin(inside), ["duplicate_row", "repeated_id", "reference_id", "bad_prefix", "missing_row", "extra_row"]
    if known is not None:
        uses = ids.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        out = out.crossJoin(uses.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").agg(total("n").alias("unknown_id")))
        rules.append("unknown_id")
    return out.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule in rules))))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source1_entity_id, id): matches that were no candidates."""
    explode = lambda rows, column: rows.select("source1_entity_id", F.explode(F.filter(F.split(column, ","), lambda x: x != "")).alias("id"))
    return explode(matches, MATCHES[1]).join(explode(candidates, CANDIDATES[1]), ["source1_entity_id", "id"], "left_anti")


def validate_file(spark: SparkSession, path: str, columns: list[str], required: DataFrame, known: DataFrame | None = None) -> list[str]:
    """Messages about a file; none if it is good. Rows are judged in place, and at most five examples of each rule come to the driver."""
    try:
        lines = spark.read.text(path)
        if not lines.where(~F.is_valid_utf8("value")).isEmpty():
            return ["the file is not UTF-8"]
        lines = lines.where("trim(value) <> ''")
        first = lines.first()
    except (PySparkException, Py4JJavaError) as failure:  # a missing or unreadable file is a finding; other failures are failures
        return [f"the file can't be read: {type(failure).__name__}"]
    head = "\t".join(columns)
    if first is None:
        return ["the file is empty"]
    if first.value.replace("\ufeff", "").strip().lower() != head:
        return ["the header has commas for tabs"] if "," in first.value and "\t" not in first.value else [f"the header is not {head!r}"]
    body = lines.where(F.lower(F.trim("value")) != head)
    messages = [f"no tab: {r.value[:60]}" for r in body.where(~F.col("value").contains("\t")).limit(EXAMPLES).collect()]
    parts = F.split("value", "\t", 2)
    rows = body.where(F.col("value").contains("\t")).select(F.trim(F.get(parts, F.lit(0))).alias(columns[0]), F.trim(F.get(parts, F.lit(1))).alias(columns[1]))
    rules = broken_rules(rows, columns[1], required, known)
    for r in findings(rows, columns[1], required, known).where("n > 0").collect():
        examples = [x.what for x in rules[r.rule].distinct().orderBy("what").limit(EXAMPLES).collect()]
        messages.append(f"{r.rule}: {r.n}, as {', '.join(examples)}")
    return messages


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="").na.fill("")


def validate(spark: SparkSession, matches: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """Errors and warnings about a file of matches and, if there is one, of candidates."""
    errors, warnings = [f"matches: {m}" for m in validate_file(spark, matches, MATCHES, required, known)], []
    if known is None:
        warnings.append("ids were not checked against the targets")
    if candidates is None:
        return errors, [*warnings, "there is no file of candidates"]
    more = [f"candidates: {m}" for m in validate_file(spark, candidates, CANDIDATES, required, known)]
    if not errors and not more:
        lost = outside_candidates(read_result(spark, matches), read_result(spark, candidates))
        if n := lost.count():
            errors.append(f"{n} matches are no candidates, as {', '.join(r.id for r in lost.orderBy('source1_entity_id', 'id').limit(EXAMPLES).collect())}")
    return errors + more, warnings


def merge_parts(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """parts(source1_entity_id, candidate_entity_ids, matched_entity_ids) of all runs, one row for each query; else raises."""
    dup = parts.groupBy("source1_entity_id").agg(F.count("*").alias("n")).where("n > 1").count()
    ids = queries.select(F.col("entity_id").alias("source1_entity_id"))
    missing, extra = ids.join(parts, "source1_entity_id", "left_anti").count(), parts.join(ids, "source1_entity_id", "left_anti").count()
    if dup or missing or extra:
        raise ValueError(f"{dup} predictions are repeated, {missing} are missing, {extra} are extra")
    return parts
