"""Substring dedup: paragraphs that repeat, wholly or nearly, by MinHash banding.

Paragraphs are of two kinds. A line of at least ``MIN_WORDS`` words has 18 bands of three values: a pair of Jaccard similarity
0.8 shares none once in 400,000 times; lines that share a band are joined and verified by the exact Jaccard similarity of their
five-word shingles. So that passages of over 50 words are found whatever their lines, each run of ``passages.WIDTH`` words is a
paragraph too, with one band of one value, the least hash of its runs of ``passages.RUN`` words: equal ones always share it, and
those that share it are verified to be equal. Of each component, or of equal runs, the first paragraph stays and the others go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import chunks
from .clustering import bucketed, cluster
from .common import Scratch, row_key, tidy, with_few
from .near_dups import hash_constants
from .passages import WIDTH as PASSAGE
from .passages import WORD_BITS, cut, placed, windows
from .shingles import Shingled, mix, shingle

MIN_WORDS = 25
WIDTH, SHARE = 5, (80, 100)
BANDS, BAND = 18, 3
CHUNK_CHARS = 1_000_000
PROFILE = "rk long, th long, doc_id long, n_words int, lines array<struct<line:int,lo:int,hi:int,sh:long,n:long,bands:binary>>, marks array<bigint>"
LINE = [("line", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("sh", pa.int64()), ("n", pa.int64()), ("bands", pa.binary())]
RESULTS = ("n_words", "n_removed", "n_spans")


def band_values(got: Shingled) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    a, b = hash_constants(BANDS * BAND)
    keys = np.zeros((len(got.bounds) - 1, BANDS), np.uint64)
    for k in range(BANDS * BAND):
        keys[:, k // BAND] = mix(keys[:, k // BAND] + got.reduce(np.minimum, mix(got.hashes ^ a[k]) * b[k], 0) + np.uint64(k))
    return keys


def profile(rows: DataFrame, min_words: int | None) -> DataFrame:
    """PROFILE, a row for each of rows(rk, th, doc_id, text): its lines of min_words words at least, as ranges of words, and the marks of its passages."""

    def lines_of(part: list[str]) -> pa.ListArray:
        lines = [x.split("\n") for x in part]
        first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        owner = np.repeat(np.arange(len(part)), np.diff(first))
        got = shingle([y for x in lines for y in x], WIDTH)
        ends = np.concatenate([[0], np.cumsum(got.n_words)])
        keep = np.nonzero(got.n_words >= min_words)[0]
        sizes = np.diff(got.bounds)
        wanted = np.zeros(len(sizes), bool)
        wanted[keep] = True
        kept = Shingled(got.hashes[np.repeat(wanted, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]), got.n_words[keep])
        base = ends[first[owner[keep]]]
        values = [keep - first[owner[keep]], ends[keep] - base, ends[keep + 1] - base, kept.set_hash(), sizes[keep], [x.tobytes() for x in band_values(kept)]]
        fields = pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, LINE, strict=True)], names=[n for n, _ in LINE])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[keep], np.arange(len(part) + 1)), pa.int32()), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist(), CHUNK_CHARS):
                rows, got = batch.slice(at, len(part)), windows(part, marks_only=True)
                of, marks = got.marked
                lines = pa.nulls(len(part), pa.list_(pa.struct(LINE))) if min_words is None else lines_of(part)
                marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32()), pa.array(marks, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("rk"), rows.column("th"), rows.column("doc_id"), pa.array(np.diff(got.before), pa.int32()), lines, marks], names=["rk", "th", "doc_id", "n_words", "lines", "marks"])
                at += len(part)

    return rows.select("rk", "th", "doc_id", "text").mapInArrow(tidy(run), PROFILE)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, sh, n), a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(len(batch), BANDS)
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k].copy()), batch.column("sh"), batch.column("n")], names=["key", "sh", "n"])

    return classes.select("sh", "n", "bands").mapInArrow(tidy(run), "key long, sh long, n long")


def here(place: str):
    """Where something stands: by doc_id, nulls last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", F.col(place).alias("at"))


def repeated_lines(rows: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """(rk, lo, hi) of lines that are linked to an earlier one; rows(rk, text), held of profile()."""
    lines = held.select("rk", "doc_id", F.inline("lines"))
    classes = scratch.save(lines.groupBy("sh").agg(F.min(F.struct(here("lo").alias("here"), "line")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    keys = band_keys(classes)
    members = scratch.save(bucketed(keys, scratch), "members")

    def fetch(wanted: DataFrame) -> DataFrame:
        at = wanted.join(classes.select("sh", "first.here.rk", "first.line"), "sh").groupBy("rk").agg(F.collect_list(F.struct("sh", "line")).alias("lines"))
        at = scratch.save(at, f"wanted-{uuid.uuid4().hex}")
        found = with_few(rows.select("rk", F.split(F.coalesce("text", F.lit("")), "\n").alias("parts")), at, "rk")
        return found.select(F.inline(F.transform("lines", lambda x: F.struct(x["sh"].alias("sh"), F.get("parts", x["line"]).alias("text"))))).dropDuplicates(["sh"])

    _, roots = cluster(members, scratch, WIDTH, SHARE, fetch)
    scratch.drop("members")
    found = classes.select("sh", "first.here").join(roots.withColumnRenamed("node", "sh"), "sh", "left").withColumn("root", F.coalesce("root", "sh"))
    stays = scratch.save(found.join(found.groupBy("root").agg(F.min("here").alias("least")), "root").select("sh", "least"), "stays")
    scratch.drop("classes", "shared", "links-leader", "links-hub", "links-rest")
    return lines.select("rk", "doc_id", "lo", "hi", "sh").join(stays, "sh").where(~here("lo").eqNullSafe(F.col("least"))).select("rk", "lo", "hi")


def turned(rows: DataFrame, one: str, many: str) -> DataFrame:
    """(b, as) of rows(a, bs), a batch at a time: rows (rk, marks) become (mark, rks) and back. A frequent mark so has a row for each batch only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(f"{many}s")
            flat, owner = lists.flatten().to_numpy(), np.repeat(batch.column(one).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.nonzero(np.concatenate([[True] * (len(flat) > 0), flat[1:] != flat[:-1]]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(flat[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(owner))], names=[many, f"{one}s"])

    return rows.select(one, f"{many}s").mapInArrow(tidy(run), f"{many} long, {one}s array<bigint>")


def in_order(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(rk, n_words, o, head) of profile(): o counts the rows by doc_id, nulls last; head is the first row of those with the same text."""
    rows = held.select("rk", "th", "doc_id", "n_words").dropDuplicates(["rk"]).orderBy(F.col("doc_id").asc_nulls_last(), "rk")
    parts = scratch.save(rows.select("rk", "th", "n_words", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "parts")
    offsets, before = [], 0
    for r in sorted(parts.groupBy("p").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        offsets.append((r.p, before))
        before += r.n
    table = held.sparkSession.createDataFrame(offsets, "p int, before long")
    rows = parts.join(F.broadcast(table), "p").select("rk", "th", "n_words", (F.col("i") + F.col("before")).alias("o"))
    found = scratch.save(rows.join(rows.groupBy("th").agg(F.min("o").alias("first")), "th").select("rk", "n_words", "o", (F.col("o") == F.col("first")).alias("head")), "order")
    scratch.drop("parts")
    return found


def repeated_passages(rows: DataFrame, held: DataFrame, order: DataFrame, scratch: Scratch) -> DataFrame:
    """(rk, ranges) of runs of PASSAGE words that stand earlier too; rows(rk, text), held of profile(), order of in_order().

    Of equal texts only the first one is searched: of all others every run stands earlier.
    """
    heads = held.select("rk", "marks").join(order.where("head").select("rk"), "rk", "left_semi").dropDuplicates(["rk"])
    # written tables: a join of two shuffles without an aggregate between can be split where a passage is frequent, and no stage needs two workers a task
    marks = scratch.save(turned(heads, "rk", "mark"), "marks")
    shared = scratch.save(marks.groupBy("mark").agg(F.sum(F.size("rks")).alias("times")).where("times > 1").select("mark"), "marks-shared")
    wanted = turned(with_few(marks, shared, "mark"), "mark", "rk").groupBy("rk").agg(F.flatten(F.collect_list("marks")).alias("marks")).join(order.select("rk", "o"), "rk")
    wanted = scratch.save(wanted, "wanted")
    scratch.drop("marks")
    asked = with_few(rows.select("rk", "text"), wanted.select("rk"), "rk").dropDuplicates(["rk"])
    found = scratch.save(placed(asked.join(wanted, "rk")), "windows")
    scratch.drop("marks-shared", "wanted")
    first = scratch.save(found.groupBy("h", "mark").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first <> last").select("h", "mark", "first"), "firsts")
    document, word = lambda c: F.shiftright(c, WORD_BITS), lambda c: F.col(c).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    later = found.join(first, ["h", "mark"]).where("pos <> first").select(document("pos").alias("o"), word("pos").alias("word"), word("first").alias("at"), (document("pos") == document("first")).alias("own"))
    lo = F.when(F.col("own"), F.greatest("word", F.col("at") + PASSAGE)).otherwise(F.col("word"))
    ranges = later.select("o", lo.alias("lo"), (F.col("word") + PASSAGE).alias("hi")).where("lo < hi").groupBy("o").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    copies = order.where(~F.col("head") & (F.col("n_words") >= PASSAGE)).select("rk", F.array(F.struct(F.lit(0).alias("lo"), F.col("n_words").alias("hi"))).alias("ranges"))
    return ranges.join(order.select("rk", "o"), "o").select("rk", "ranges").union(copies)


def merged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of lists of ranges: those of a row that overlap or meet are one."""
    values, sizes = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    of, lo, hi = np.repeat(np.arange(len(sizes)), sizes), values.field("lo").to_numpy().astype(np.int64), values.field("hi").to_numpy().astype(np.int64)
    order = np.lexsort((lo, of))
    of, lo = of[order], lo[order]
    ends = np.maximum.accumulate((of << 32) + hi[order])
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] << 32) + lo[1:] > ends[:-1]
    first = np.nonzero(fresh)[0]
    return of[first], lo[first], ends[np.append(first[1:], len(of)) - 1] - (of[first] << 32) if len(of) else hi


def without(rows: DataFrame, text: str, gone: str) -> DataFrame:
    """rows with the ranges of words in gone and the blanks behind them cut out of text, n_removed and n_spans."""
    kept = [f for f in rows.schema if f.name != gone]
    schema = T.StructType([*kept, T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (of, lo, hi) = batch.column(text).to_pylist(), merged(batch.column(gone))
            removed, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            hit, at = np.unique(of).tolist(), 0
            first, last = np.searchsorted(of, hit, "left"), np.searchsorted(of, hit, "right")
            for part in chunks([texts[i] for i in hit], CHUNK_CHARS):
                own, ranges = hit[at : at + len(part)], zip(first[at : at + len(part)], last[at : at + len(part)], strict=True)
                for i, (left, n, m) in zip(own, cut(part, [list(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)) for a, b in ranges]), strict=True):
                    texts[i], removed[i], count[i] = left, n, m
                at += len(part)
            columns = [pa.array(texts, pa.string()) if f.name == text else batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed), pa.array(count)], names=[f.name for f in schema])

    return rows.mapInArrow(tidy(run), schema)


def dedup_paragraphs(docs: DataFrame, scratch: Scratch, min_words: int | None = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs(doc_id, text, ...), with text replaced by what is left, and n_words, n_removed (words) and n_spans (of removed words).

    A line of min_words words at least goes if one that is linked to it stands earlier: in a lesser doc_id (nulls last), or
    further up in the same text. A run of PASSAGE words or more goes if it stands earlier, A-Z lower-cased and with any blanks and
    line ends between its words; where a text repeats itself with an overlap, the first PASSAGE words of that stay. Both are
    judged on the input, not on what is left. The blanks and line ends behind removed words go with them. min_words None:
    passages only. Very long texts are read whole, a text at a time. A null text stays null and has no words, an empty one is
    left alone, an empty table gives an empty one. Rows that are alike count as one and are treated alike; of rows with one
    doc_id and different texts, a hash decides which is earlier. Columns of docs with the names of results are replaced;
    ``__rk`` and ``__gone`` are reserved.
    """
    docs = docs.drop(*RESULTS)
    rows = docs.select(row_key().alias("rk"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("doc_id").cast("long"), F.col("text"))
    held = scratch.save(profile(rows, min_words), "profile")
    order = in_order(held, scratch)
    facts = order.select("rk", "n_words").join(repeated_passages(rows, held, order, scratch).withColumnRenamed("ranges", "passages"), "rk", "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    gone = F.coalesce("passages", none)
    if min_words is not None:
        lines = repeated_lines(rows, held, scratch).groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("lines"))
        facts, gone = facts.join(lines, "rk", "left"), F.concat(gone, F.coalesce("lines", none))
    facts = scratch.save(facts.select("rk", "n_words", gone.alias("gone")), "facts-rows")
    scratch.drop("profile", "order", "windows", "firsts", "stays")
    facts = facts.select(F.col("rk").alias("__rk"), F.col("n_words").cast("long").alias("n_words"), F.col("gone").alias("__gone"))
    out = without(docs.withColumn("__rk", row_key()).join(facts, "__rk").drop("__rk"), "text", "__gone")
    return out.select(*docs.columns, *RESULTS)


def drop_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """All rows and columns of docs, without passages that stand earlier too; see dedup_paragraphs."""
    return dedup_paragraphs(docs, scratch, None).select(docs.columns)
