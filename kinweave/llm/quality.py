"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The trees are grown level by level on binned statistics of a bounded sample of labelled rows, and flattened into arrays; a
batch of documents walks all of them at once, by numpy gathers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .byte_bpe import chunks
from .common import tidy

#: Labelled rows that are learned from at most: those with the least hashes of their ids.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAST_HESSIAN = 60, 4, 64, 0.2, 1.0, 1.0
#: Counted kinds of bytes: other, lower case, upper case, digits, blanks, line ends, bytes over 127, ! ? . , and each of some signs.
SIGNS = "#%&$*|!.,;:'\"(){}[]<>/\\=+-_@~^"
KIND = np.zeros(256, np.int64)
for i, group in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", "", *"#%&$*|!", ".,", SIGNS[9:]]):
    for sign in group:
        KIND[ord(sign)] = i + 1
KIND[128:] = 6
KINDS = 16
N_FEATURES = KINDS + 10


def statistics(texts: list[str]) -> np.ndarray:
    """A row of statistics for each text; an empty text has zeros."""
    out = np.zeros((len(texts), N_FEATURES))
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(x) for x in data])
    which = np.repeat(np.arange(len(data)), size)
    counts = np.bincount(which * KINDS + KIND[np.frombuffer(b"".join(data), np.uint8)], minlength=len(data) * KINDS).reshape(-1, KINDS)
    out[:, :KINDS] = counts / np.maximum(size, 1)[:, None]
    letters = counts[:, 1] + counts[:, 2] + counts[:, 6]
    out[:, KINDS] = counts[:, 2] / np.maximum(letters, 1)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        seen, n = Counter(words), len(words)
        lines = text.split("\n")
        length = len(text) - n + 1
        out[i, KINDS + 1 :] = (
            len(seen) / n,
            len(seen) / n**0.5,
            max(seen.values()) / n,
            length / n,
            len(set(lines)) / len(lines),
            n / len(lines),
            sum(map(str.isupper, seen)) / len(seen),
            sum(map(str.isalpha, seen)) / len(seen),
            sum(k * (k - 1) for k in seen.values()) / max(1, n * (n - 1)),
        )
    return out


@dataclass
class Forest:
    """Perfect trees of one depth: inner nodes level by level, then leaves."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees of log loss; without rows, or with rows of one class, every score is that class's (1 without rows)."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    positive = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
    start = float(np.log(positive / (1 - positive)))
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, inner))
        return Forest(none.astype(np.int64), none, np.zeros((0, leaves)), start)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    flat = binned + np.arange(width) * BINS
    features, thresholds, values = (np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    total = np.full(n, start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            index = ((node - first)[:, None] * width * BINS + flat).ravel()
            g, h = (np.bincount(index, np.repeat(w, width), count * width * BINS).reshape(count, width, BINS) for w in (slope, bend))
            gl, hl = g.cumsum(2), h.cumsum(2)
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(hl < LEAST_HESSIAN) | (ha - hl < LEAST_HESSIAN)] = 0
            best = gain.reshape(count, -1).argmax(1)
            f, b = np.divmod(best, BINS)
            for k in range(count):
                if gain[k, f[k], b[k]] > 1e-9 and b[k] < len(edges[f[k]]):
                    features[t, first + k], thresholds[t, first + k] = f[k], edges[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        place = node - inner
        g, h = np.bincount(place, slope, leaves), np.bincount(place, bend, leaves)
        values[t] = -RATE * g / (h + L2)
        total += values[t][place]
    return Forest(features, thresholds, values, start)


def held_out() -> Column:
    """Rows that are never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Learns labels(doc_id, quality) from the texts of docs. Labels of one id that disagree count as 0; null labels don't count.

    Of texts that share an id, the one with the least statistics is learned from."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), batch.column("y").slice(at, len(part)).cast(pa.int32()), pa.array(list(statistics(part)), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    # sample has sample_rows rows at most: that bounds what is broadcast, and with one row an id what comes to the driver
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("y").cast("int")).mapInArrow(tidy(run), f"doc_id {kind}, y int, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("least")).select("doc_id", "least.y", "least.x").toPandas()
    rows = rows.assign(k=[tuple(x) for x in rows.x]).sort_values(["doc_id", "k"])
    x = np.array(list(rows.k), float).reshape(-1, N_FEATURES)
    return grow(x, (rows.y.to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the added columns held_out, score (0 to 1) and predicted (1 if score >= 0.3).

    Scores look at nothing but the text; a null text is empty, and empty texts have zero statistics and are scored like
    others. Repeated rows are scored alike. Columns of docs with the names of results are replaced.
    """
    forest = train(docs, labels, sample_rows)
    rest = docs.drop("held_out", "score", "predicted")
    schema = rest.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text").to_pylist()):
                got = forest.score(statistics(part))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns), pa.array(got)], names=[*schema.names, "score"])
                at += len(part)

    scored = rest.mapInArrow(tidy(run), StructType([*schema.fields, StructField("score", DoubleType())]))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
