"""Document quality: histogram gradient-boosted trees over document statistics.

The trees are grown on at most ``MAX_TRAIN_ROWS`` labelled rows (those with the least
hash of their id, so a fixed sample), flattened into arrays of one complete binary tree
each and applied to whole Arrow batches, a tree level at a time.  Labels join to ids; a
text is read once to be scored, where it lies, and is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, written

MAX_TRAIN_ROWS = 20_000  # the bound of the training sample
ACCEPT = 0.7
TREES, DEPTH, BINS, RATE, L2, MIN_WEIGHT = 80, 4, 64, 0.15, 1.0, 2.0

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "lower", "digit", "high_byte", "stops", "commas", "shouts", "hashes", "bars",
    "other_marks", "marks_a_word", "log_lines", "line_length", "distinct_lines", "distinct_words", "top_word", "repeats", "pair_marks", "word_end_marks", "long_words", "title_words",
]
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all zero for null and empty texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(data, dtype=np.uint8)
    c = np.bincount(raw, minlength=256)
    n, w = len(raw), len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    ends = np.frombuffer(b"".join([x[-1:] for x in words]), dtype=np.uint8)
    end_marks = np.isin(ends, _MARKS) & (ends != 46) & (ends != 44)
    marks = int(c[_MARKS].sum())
    is_mark = _mark_table[raw]
    pairs = int((is_mark[1:] & (raw[1:] == raw[:-1])).sum())
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(lengths.mean()), float(lengths.std()), c[_UPPER].sum() / n, c[_LOWER].sum() / n, c[_DIGIT].sum() / n,
        c[128:].sum() / n, c[46] / w, c[44] / w, c[33] / w, (c[35] + c[36] + c[37] + c[38] + c[42]) / w, c[124] / w,
        (marks - c[46] - c[44]) / n, marks / w, float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))), len(set(lines)) / max(1, len(lines)), len(counts) / w,
        max(counts.values()) / w, sum(map(bytes.__eq__, words, words[1:])) / w, pairs / w, end_marks.sum() / w, float((lengths > 20).mean()), sum(x[:1].isupper() for x in words) / w,
    ]


_mark_table = np.zeros(256, dtype=bool)
_mark_table[_MARKS] = True


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with the statistics of their whole texts, array<float> ``into``; all zero
    for null and empty texts.  Other columns stay as they are."""

    @F.arrow_udf("array<float>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float32()))

    return docs.withColumn(into, found(F.col(text_col).cast("string")))


@dataclass(frozen=True)
class FlatTrees:
    """Complete binary trees: node k has children 2k+1 and 2k+2; leaves follow the last level."""

    base: float
    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            margin += leaf[at - (len(feature))]
        return 1.0 / (1.0 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray) -> FlatTrees:
    """Boost trees on the logistic loss with histograms of ``BINS`` quantile bins."""
    n, m = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    rate = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate / (1 - rate)))
    inner, shape = 2**DEPTH - 1, (0, 2**DEPTH - 1)
    if n == 0 or y.min() == y.max():
        return FlatTrees(base, np.zeros(shape, np.int64), np.zeros(shape), np.zeros((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, out = np.full(n, base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = (at - first) * BINS + binned[:, j]
                gs = np.bincount(key, g, nodes * BINS).reshape(nodes, BINS)
                hs = np.bincount(key, h, nodes * BINS).reshape(nodes, BINS)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < MIN_WEIGHT) | (ht - hl < MIN_WEIGHT)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                for node in np.nonzero(top > best)[0]:
                    best[node], feature[first + node], cut[first + node] = top[node], j, edges[j][k[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf_at = at - inner
        value = RATE * np.bincount(leaf_at, g, 2**DEPTH) / (np.bincount(leaf_at, h, 2**DEPTH) + L2)
        margin += value[leaf_at]
        for store, item in zip(out, (feature, cut, value)):
            store.append(item)
    return FlatTrees(base, *map(np.array, out))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FlatTrees:
    """Trees from labelled, not held-out documents; rows labelled more than once take the
    mean of their labels, null labels and ids are left out, of rows of one id that with the
    least statistics is learned.  Without labels, or with one kind only, the score is the
    (smoothed) base rate.  Texts are read for the ``MAX_TRAIN_ROWS`` ids of the sample only."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y"))
    ids = docs.select(F.col(id_col).alias("_id")).distinct()
    sample = written(known.join(ids, "_id").orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN_ROWS), "sample")
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # MAX_TRAIN_ROWS rows at most
    rows = with_statistics(chosen, "_text", "_stats").groupBy("_id", "_y").agg(F.min("_stats").alias("_stats")).orderBy("_id").toArrow()
    if not rows.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = np.array(rows["_stats"].combine_chunks().flatten(), dtype=np.float64).reshape(rows.num_rows, -1)
    return grow(x, (rows["_y"].to_numpy() >= 0.5).astype(np.float64))


def score(docs: DataFrame, model: FlatTrees, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of their whole texts, between 0 and 1: the higher, the
    likelier is label 1.  Null and empty texts have the score of statistics that are zero."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def found(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts], dtype=np.float32).astype(np.float64).reshape(len(texts), len(STATISTICS))
        return pa.array(shared.value.score(x), pa.float64())

    return docs.withColumn(into, found(F.col(text_col).cast("string")))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; null and empty texts are scored as well."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
