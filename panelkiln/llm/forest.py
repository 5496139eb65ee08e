"""Nearest neighbours by inner product with a hash-prefix forest.

A tree hashes every vector to a long bit string (signs of random projections) and keeps
the strings in a sorted array.  A query descends in each tree to its longest prefix
match (binary search), then all trees ascend together, one bit at a time, and everything
under the common level is a candidate, until there are enough; candidates alone are scored.

The index is dealt by a hash of its vectors to shards of about ``SHARD_ROWS`` rows; every
shard is a forest of its own, and blocks of queries visit all shards (a stated query set
against all rows).  A shard gives at most ``k`` ids for each query, merged by a window.
Vectors with equal values are one entry with its ``k + 1`` smallest ids, so a vector
found in a third of all rows fills no shard.

For inner products of vectors of unequal length, one component is added that brings all
index vectors to the largest length (queries have 0 there).

``SHARE``: trees ascend until this share of a shard, and ``LEAST * k`` rows of it (all, if
it has no more), are candidates.  Vectors without structure (the given ones are close to uniform on a sphere in 64 dimensions) need a large
one for a recall of 0.9; figures are in the README.  Clustered vectors need far less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written

TREES, BITS, SHARE, LEAST, SHARD_ROWS, QUERY_ROWS = 128, 32, 0.3, 40, 8192, 256
SEED = 11


def _candidates(index_bits: np.ndarray, query_bits: np.ndarray, least: int) -> np.ndarray:
    """A (query, row) mask of candidates.

    index_bits and query_bits: (TREES, n) uint64 hash strings.  Trees ascend together from
    the longest match of any of them, until they hold ``least`` rows."""
    trees, n = index_bits.shape
    q = query_bits.shape[1]
    order = np.argsort(index_bits, axis=1, kind="stable")
    arrays = np.take_along_axis(index_bits, order, axis=1)
    longest = np.zeros(q, dtype=np.int64)  # the longest prefix that a neighbour in a sorted array shares
    for t in range(trees):
        at = np.searchsorted(arrays[t], query_bits[t])
        for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
            apart = arrays[t][near] ^ query_bits[t]
            longest = np.maximum(longest, BITS - np.ceil(np.log2(apart.astype(np.float64) + 1)).astype(np.int64))
    mask = np.zeros((q, n), dtype=bool)
    open_ = np.arange(q)
    for level in range(int(longest.max(initial=0)), -1, -1):
        now = open_[longest[open_] >= level]
        if not len(now):
            continue
        rest = np.uint64(BITS - level)
        low, high = np.empty((trees, len(now)), dtype=np.int64), np.empty((trees, len(now)), dtype=np.int64)
        for t in range(trees):
            prefix = (query_bits[t, now] >> rest) << rest
            low[t] = np.searchsorted(arrays[t], prefix, side="left")
            high[t] = np.searchsorted(arrays[t], prefix | ((np.uint64(1) << rest) - np.uint64(1)), side="right")
        size = high - low
        enough = size.sum(axis=0) >= least  # rows of several trees count in each: they may still be too few
        if not enough.any():
            continue
        low, size, asks = low[:, enough], size[:, enough].ravel(), now[enough]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        tree = np.repeat(np.repeat(np.arange(trees), len(asks)), size)
        mask[np.repeat(np.tile(asks, trees), size), order[tree, np.repeat(low.ravel(), size) + within]] = True
        open_ = np.setdiff1d(open_, asks[mask[asks].sum(axis=1) >= least])
        if not len(open_):
            break
    mask[open_] = True
    return mask


def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, TREES * BITS))


def _strings(vectors: np.ndarray) -> np.ndarray:
    bits = (vectors @ _planes(vectors.shape[1]) > 0).reshape(len(vectors), TREES, BITS)
    return (bits.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).T


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _search_shard(k: int, longest: float):
    def run(queries, index):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        x, y = _vectors(index["vector"]), _vectors(queries["vector"])
        extra = np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(axis=1)))
        rows = _strings(np.hstack((x, extra[:, None])))
        ids, asks = index["ids"].to_pylist(), queries["query_id"].to_numpy()
        out_q, out_v, out_s = [], [], []
        for a in range(0, len(y), QUERY_ROWS):
            block = y[a : a + QUERY_ROWS]
            mask = _candidates(rows, _strings(np.hstack((block, np.zeros((len(block), 1))))), max(LEAST * k, int(SHARE * len(x))))
            for i in range(len(block)):
                near = np.flatnonzero(mask[i])
                scores = (x[near] * block[i]).sum(axis=1)  # in one order of addition, whatever the shard
                take = min(len(near), 2 * (k + 1))
                while True:  # ids of several vectors count once: more rows until there are k
                    top = np.argpartition(-scores, take - 1)[:take] if take < len(near) else np.arange(len(near))
                    top = np.flatnonzero(scores >= scores[top].min(initial=np.inf)) if take < len(near) else top
                    best: dict = {}
                    for s, v in sorted((-s, v) for s, j in zip(scores[top].tolist(), near[top].tolist()) for v in ids[j] if v != asks[a + i]):
                        best.setdefault(v, -s)
                    if len(best) >= k or take >= len(near):
                        break
                    take = min(len(near), 4 * take)
                found = list(best.items())[:k]
                out_q += [int(asks[a + i])] * len(found)
                out_v += [v for v, _ in found]
                out_s += [s for _, s in found]
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], schema=schema)

    return run


def nearest(vectors: DataFrame, query_ids, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that satisfies the Column ``query_ids``
    its ``k`` nearest other rows, ties to the smaller id; fewer if there are fewer.

    Vectors that are null, zero, of another size than most, or hold null or non-finite
    components take no part, nor do null ids.  Repeated rows are one.  An id with several
    vectors is found, and asks, by each of them and has its best score; a row is never a
    neighbour of its own id.  Without queries the result is empty."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    clean = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(F.col(id_col).isNotNull() & F.coalesce(clean, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.coalesce(query_ids, F.lit(False)).alias("asks"))
    good = written(good.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks")), "vectors")  # repeated rows are one
    size = good.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = size["d"] if size else 1
    good = good.where(F.size("vector") == d)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = good.agg(F.count("*").alias("n"), F.coalesce(F.max(F.sqrt(square)), F.lit(0.0)).alias("longest")).first()
    shards = max(1, -(-facts["n"] // SHARD_ROWS))
    key = F.xxhash64("vector")
    first = good.select("vec_id", "vector", key.alias("key")).withColumn("r", F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = first.groupBy("key", "vector").agg(F.collect_list("vec_id").alias("ids")).select("vector", "ids", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
    # queries are dealt to blocks, so that a task holds one shard and one block of queries
    blocks = max(1, -(-facts["n"] // (4 * SHARD_ROWS)), -(-shuffle_partitions(spark) // (4 * shards)))
    asked = good.where("asks").select(F.col("vec_id").alias("query_id"), "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(_search_shard(k, facts["longest"]), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth id among all other rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
