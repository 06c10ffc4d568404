"""How far the sources of a language differ in their words, and which words make a source differ.

Terms are counted by source; a term's counts are a sparse vector over the sources. Many terms share one vector, so the
distances of sources are worked out once for each distinct vector and multiplied by the number of its terms; only the
ranking of terms goes back to the terms themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .numbers import numbered

LEAST_DOCS, SMOOTH, TOP = 30, 5, 50
#: A share is a whole number of billionths; the two factors keep products small.
SCALE = (31_250, 32_000)
#: Different terms that a worker counts before it sends them on, bytes of a text that it splits at a time, groups (sources of a language) in a block, numbers in a matrix.
HELD, PIECE, BLOCK, CELLS = 400_000, 1 << 20, 1024, 2_000_000

#: What bytes become before a text is split at blanks: A-Z are lower-cased; letters and bytes beyond ASCII stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    data, at = text.translate(TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that have the term, in parts that are to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = {}
        having: dict[tuple[str, str], Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                names, docs_of = list(found), having[lang, source]
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([found[t] for t in part], pa.int64()), pa.array([docs_of[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])
            times.clear()
            having.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                key, own = (lang.as_py(), source.as_py()), set()
                found = times.setdefault(key, Counter())
                for words in terms(text.as_py()):
                    found.update(words)
                    own.update(words)
                having.setdefault(key, Counter()).update(own)
            if sum(map(len, times.values())) >= HELD:
                yield from sent()
        yield from sent()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "lang string, source string, term string, n long, d long")


def share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kinds)), by a long division that has no large products."""
    whole, first = f"({total} + {SMOOTH} * {kinds})", f"(({count} + {SMOOTH}) * {SCALE[0]}L)"
    return F.expr(f"1 + ({first} div {whole}) * {SCALE[1]}L + ({first} % {whole} * {SCALE[1]}L) div {whole}")


def pair_sums(vectors: DataFrame, stats: list, low: range, high: range) -> DataFrame:
    """(a, b, value): of groups a in low and b in high, a < b, of one language, the sums of |p - q| over all terms.

    vectors(first, vec, m): the least group of the language, counts as (group, n), and the number of terms with them; stats
    has group, first, total and kinds of the groups of both blocks. A task adds up all its vectors before it sends a row a pair.
    """
    of: dict[int, list] = {}
    for r in stats:
        of.setdefault(r.first, []).append((r.gid, r.total, r.kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}

        def begun(first: int) -> tuple:
            ids = np.array([g for g, _, _ in sorted(of[first])])
            whole = np.array([t + SMOOTH * k for _, t, k in sorted(of[first])], np.int64)
            a, b = (np.flatnonzero((ids >= x.start) & (ids < x.stop)) for x in (low, high))
            none = shares(np.zeros(len(ids), np.int64), whole)
            return ids, whole, none, a, b, np.zeros((len(a), len(b)), np.int64)

        def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
            whole = np.maximum(whole, 1)  # no terms, no vectors but empty ones of no weight
            part, rest = np.divmod((n + SMOOTH) * SCALE[0], whole)
            return 1 + part * SCALE[1] + rest * SCALE[1] // whole

        for batch in batches:
            firsts, m, vec = batch.column("first").to_numpy(), batch.column("m").to_numpy(), batch.column("vec")
            rows = np.repeat(np.arange(len(batch)), vec.value_lengths().to_numpy())
            flat = vec.flatten()
            gid, n = (flat.field(k).to_numpy() for k in range(2))
            for first in np.unique(firsts).tolist():
                if first not in made:
                    made[first] = begun(first)
                ids, whole, none, a, b, out = made[first]
                at = np.minimum(np.searchsorted(ids, gid), len(ids) - 1)
                here = (firsts[rows] == first) & (ids[at] == gid)
                touched = np.unique(rows[here])
                rest = int(m[firsts == first].sum() - m[touched].sum())  # terms that occur in none of these groups
                out += rest * np.abs(none[a][:, None] - none[b][None, :])
                r, at, p = np.searchsorted(touched, rows[here]), at[here], shares(n[here], whole[at[here]])
                step = max(1, CELLS // len(ids))
                for start in range(0, len(touched), step):
                    mine = (r >= start) & (r < start + step)
                    dense = np.repeat(none[None, :], min(step, len(touched) - start), 0)
                    dense[r[mine] - start, at[mine]] = p[mine]
                    weight, right = m[touched[start : start + step]], dense[:, b]
                    for k, x in enumerate(a):
                        out[k] += weight @ np.abs(dense[:, x, None] - right)
        for ids, _, _, a, b, out in made.values():
            i, j = np.nonzero(ids[a][:, None] < ids[b][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a][i]), pa.array(ids[b][j]), pa.array(out[i, j])], names=["a", "b", "value"])

    mine = vectors.where(F.col("first").between(min(of), max(of)))
    return mine.select("first", "m", "vec").mapInArrow(tidy(run), "a long, b long, value long")


def source_pairs(vectors: DataFrame, stats: DataFrame, n_groups: int) -> DataFrame:
    """(a, b, value) of all pairs a < b of groups of one language. Tasks know the groups of two blocks at a time, whose number is bounded; there is one block but for very many groups."""
    blocks = [range(at, min(at + BLOCK, n_groups)) for at in range(0, n_groups, BLOCK)]
    edges = {r.gid: r.first for r in stats.where(F.col("gid") % BLOCK == 0).select("gid", "first").collect()}
    sums = vectors.sparkSession.createDataFrame([], "a long, b long, value long")
    for i, low in enumerate(blocks):
        for high in blocks[i:]:
            shared = F.lit(True) if low == high else F.col("first") == edges[high.start]
            if low == high or edges[high.start] < low.stop:  # a language that begins behind low has no group in it
                near = ((F.col("gid") >= low.start) & (F.col("gid") < low.stop)) | ((F.col("gid") >= high.start) & (F.col("gid") < high.stop))
                sums = sums.union(pair_sums(vectors, stats.where(near & shared).collect(), low, high))
    return sums.groupBy("a", "b").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    return rows.select("gid", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def divergence_audit(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    A term is a run of letters and characters beyond ASCII, A-Z lower-cased; a language keeps the terms of least_docs of its
    documents at least. Part pair: item is another source of the language, value the sum over the kept terms of the
    differences of their shares. Part term: item is a kept term whose share in the source is above that in the language,
    value the difference; ranks to top only. Equal values are ranked by item.

    docs needs lang, source and text; nulls in them are ''. Other columns, of any name, are not looked at. Documents
    without text count as members of their source; repeated rows count each; without rows there is no result. A language
    without kept terms has value 0 for all its pairs, one with a single source has none. Texts are split a piece at a
    time; a worker holds one text's bytes and its different terms. The result has a row for each pair of sources, so a
    language's sources are few against its documents; they are worked on in blocks, whatever their number.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    names, n_groups = numbered(docs.select("lang", "source").distinct().repartitionByRange("lang", "source").sortWithinPartitions("lang", "source"), scratch, "names", "gid")
    groups = scratch.save(names.join(names.groupBy("lang").agg(F.min("gid").alias("first")), "lang"), "groups")
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).join(groups, ["lang", "source"])
    kept = counted.groupBy("first", "term").agg(F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("gid", "n"))).alias("vec")).where(F.col("d") >= least_docs)
    kept = scratch.save(kept.select("first", "term", "vec"), "kept")
    entries = kept.select("first", "term", F.aggregate("vec", F.lit(0).cast("long"), lambda n, e: n + e["n"]).alias("everywhere"), F.explode("vec").alias("e")).select("first", "term", "everywhere", "e.gid", "e.n")
    stats = groups.join(entries.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(kept.groupBy("first").agg(F.count("*").alias("kinds")), "first", "left")
    stats = scratch.save(stats.select("gid", "first", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds")), "stats")

    none = F.array().cast(kept.schema["vec"].dataType)
    vectors = kept.groupBy("first", "vec").agg(F.count("*").alias("m")).union(groups.select("first", none, F.lit(0).cast("long")).distinct())
    sums = scratch.save(source_pairs(scratch.save(vectors, "vectors"), stats, n_groups), "sums")
    both = sums.select(F.col("a").alias("gid"), F.col("b").alias("other"), "value").union(sums.select("b", "a", "value"))
    pairs = both.join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")

    whole = stats.groupBy("first").agg(F.sum("total").alias("all"))
    values = entries.join(stats.drop("first"), "gid").join(whole, "first").withColumns({"p": share("n", "total", "kinds"), "q": share("everywhere", "all", "kinds")})
    terms_of = values.where("p > q").select("gid", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rows = ranked(pairs, "pair").union(ranked(terms_of, "term").where(F.col("rank") <= top))
    return rows.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
