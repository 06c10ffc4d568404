"""A corpus pipeline: stages over the table documents, each over all that the one before it kept.

All stages take empty tables, and any columns besides doc_id and text, of any name; they come back as they were, but for
n_chars after a stage that changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import byte_bpe, decontamination, near_dups, paragraphs, quality
from kinweave.llm.common import Scratch, documents, row_key, tokenizer_path


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column with all others, which so clash with nothing that an operator adds."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns if c not in ("doc_id", "text"))).alias("__rest"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(f"_{c}").alias(c) for c in columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject. Null and empty texts are scored like others; repeated rows have one score and stay or go together."""
    scored = quality.score_quality(packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(scored.where("predicted = 1"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each component; rows without words stay, and of rows alike in id and text one stays."""
    columns, docs = docs.columns, packed(docs)
    found = near_dups.near_duplicates(docs, Scratch(spark, "stage6"), 5, (80, 100), symbols=48)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk"))["rk"].alias("rk")
    stay = found.where("root is not null").groupBy("root").agg(least).select("rk").union(found.where("root is null").select("rk")).distinct()
    return unpacked(docs.withColumn("rk", row_key()).join(stay, "rk", "left_semi").dropDuplicates(["rk"]), columns)


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines and passages that stand earlier too; a column n_chars of whole numbers follows the text. Null texts stay null."""
    left = unpacked(paragraphs.dedup_paragraphs(packed(docs), Scratch(spark, "stage10")), docs.columns)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark passages are less than a twentieth. Null and empty texts have no words and stay; repeated rows stay or go together."""
    judged = decontamination.contamination(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "stage7"))
    return unpacked(judged.where("not contaminated"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian 32-bit words) of what is left."""
    import public_tokenizers

    got = byte_bpe.encode_decode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_paragraphs),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokens),
]

#: SQL can't express the classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
    return docs
