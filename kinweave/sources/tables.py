"""Sources: tab-separated records, labelled links, and an adapter that makes records of a table of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc

FIELDS = ["entity_id", "business_name", "business_address", "country"]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, absent fields as ''. A header and a byte order mark are understood."""
    rows = spark.read.option("multiLine", True).csv(path, sep="\t", header=True, quote='"', escape='"')
    return rows.select([F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.trim(rows.columns[0]).alias("id")).where("id <> ''").distinct()


def checked(records: DataFrame) -> DataFrame:
    """records with their four fields; raises if a field lacks, there are no rows, or an id is empty or repeated."""
    if lacking := [c for c in FIELDS if c not in records.columns]:
        raise ValueError(f"columns are missing: {lacking}")
    n, distinct, empty = records.agg(F.count("*"), F.count_distinct("entity_id"), F.count_if(F.coalesce("entity_id", F.lit("")) == "")).first()
    if n == 0 or empty or distinct != n:
        raise ValueError(f"{n} rows, {distinct} different ids, {empty} empty ids")
    return records.select(FIELDS)


def load_split(spark: SparkSession, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The reference records and the targets of a split."""
    one, two, three = (read_tsv(spark, path) for path in split_files(folder, prefix))
    return unified(checked(one)), unified(checked(two.select(FIELDS).unionByName(three.select(FIELDS))))


def unified(records: DataFrame) -> DataFrame:
    """records with names and addresses in one Unicode form (NFKC)."""
    return records.withColumns({c: nfkc(F.col(c)) for c in ("business_name", "business_address")})


def truth_links(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, target_id) of rows with a comma-separated list."""
    items = F.array_distinct(F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: x != ""))
    return truth.select("source1_entity_id", F.explode(items).alias("target_id"))


def fingerprint(records: DataFrame) -> str:
    """A digest of rows that doesn't depend on their order."""
    n, x, s = records.select(F.xxhash64(*records.columns).alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{n}-{x}-{s}"


#: Fixed values of a file's digest: lines are digits of a number to this base, modulo a prime.
DIGIT, PRIME = 0x5DEECE66D2B992DDFA23249D6, (1 << 127) - 1


def range_digests(files: DataFrame) -> DataFrame:
    """(name, start, lines, digest) of each range of files(name, start, value) that one task reads, lines in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for name, start, line in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "value")), strict=True):
                one = found.setdefault((name, start), [0, 0])
                one[0], one[1] = one[0] + 1, (one[1] * DIGIT + int.from_bytes(hashlib.sha256(line).digest()[:15])) % PRIME
        columns = [[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [f"{v[1]:x}" for v in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "start", "lines", "digest"])

    return files.mapInArrow(run, "name string, start long, lines long, digest string")


def file_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and bytes of some files, whatever their order and however Spark splits them.

    Ranges of a file are digested where they are read, and their digests are joined in the order of the ranges: a digest is a number
    whose digits are the lines, so those of two ranges give that of both. Only a row a range comes to the driver.
    """
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("start"))
    sizes = [f"{r.path.rpartition('/')[2]} {r.length}" for r in spark.read.format("binaryFile").load(paths).select("path", "length").collect()]
    whole: dict[str, int] = {}
    for r in range_digests(rows).orderBy("name", "start").collect():
        whole[r.name] = (whole.get(r.name, 0) * pow(DIGIT, r.lines, PRIME) + int(r.digest, 16)) % PRIME
    digests = [f"{name.rpartition('/')[2]} {digest:x}" for name, digest in whole.items()]
    return hashlib.sha256("\n".join([*sorted(sizes), "", *sorted(digests)]).encode()).hexdigest()


def split_files(folder: str, prefix: str) -> list[str]:
    return [f"{folder}/{prefix}_source{i}.tsv" for i in (1, 2, 3)]


def from_documents(docs: DataFrame) -> DataFrame:
    """Records with ``source`` (1, 2, 3) and ``block``: documents of a language that begin alike are one block.

    Of a block of several the least id is the reference record and the others are targets by parity; single ones go to a source
    by their id.
    """
    flat = F.regexp_replace("text", r"\s+", " ")
    block = F.concat("lang", F.lit("|"), F.substring(F.lower("text"), 1, 40))
    rows = docs.select("doc_id", F.col("lang").alias("country"), block.alias("block"), F.substring(flat, 1, 60).alias("business_name"), F.substring(flat, 61, 60).alias("business_address"))
    size = rows.groupBy("block").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"))
    source = F.when(F.col("size") == 1, 1 + F.col("doc_id") % 3).when(F.col("doc_id") == F.col("least"), 1).when(F.col("doc_id") % 2 == 0, 2).otherwise(3)
    rows = rows.join(size, "block").withColumn("source", source.cast("int"))
    number = F.col("doc_id").cast("string")
    number = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)  # lpad cuts longer ones
    return rows.select(F.concat(F.lit("S"), F.col("source"), F.lit("-"), number).alias("entity_id"), "business_name", "business_address", "country", "source", "block")


def document_truth(records: DataFrame) -> DataFrame:
    """source1_entity_id and matched_entity_ids of records from documents."""
    one = records.where("source = 1").select("block", F.col("entity_id").alias("source1_entity_id"))
    rest = records.where("source > 1").groupBy("block").agg(F.array_join(F.sort_array(F.collect_set("entity_id")), ",").alias("ids"))
    # a block with a reference record of its own and targets; single targets have blocks without one
    return one.join(rest, "block", "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 2026, by: str | None = None) -> DataFrame:
    """n rows (of each value of ``by``) that have the least hashes of key and seed: the same ones in every run."""
    order = [F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))), F.col(key)]
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
