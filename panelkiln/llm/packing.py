"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Bins are kept in order of their residual room, each with a bitmap of its sources and
one of its duplicate clusters.  A document (longest first) looks up the smallest
residual that fits and walks to its successors until a bin holds neither its source nor
its cluster; so it gets the tightest compatible bin, or a new one.

Documents are dealt to shards by a hash of their id, each of about ``SHARD_TOKENS``
tokens or ``SHARD_ROWS`` rows, so a shard is small whatever the skew in sources or clusters, and bins of
different shards never mix.  Only lengths travel, not texts.  A document longer than a
bin is cut: full bins first, then its rest is packed like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

CAPACITY = 2048
SHARD_TOKENS, SHARD_ROWS = 2_000_000, 8192
WORD = r"[^\x20\x09-\x0D]+"
PACKED = "row_id long, piece int, first_token long, n_tokens long, bin string, residual long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster), in the given order."""
    residuals: list[tuple[int, int]] = []  # (room, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        k = bisect_left(residuals, (size, -1))
        while k < len(residuals) and (sources[residuals[k][1]] & s or clusters[residuals[k][1]] & c):
            k += 1
        if k < len(residuals):
            room, b = residuals.pop(k)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(residuals, (room - size, b))
        out.append(b)
    return out


def _codes(values: pd.Series) -> list[int]:
    """Bit numbers of values; each null is a value of its own."""
    codes, _ = pd.factorize(values)
    free = codes.max(initial=-1) + 1
    return [int(c) if c >= 0 else (free := free + 1) - 1 for c in codes]


def _pack_shard(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "row_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        bins = best_fit(list(zip(rows["n_tokens"].tolist(), _codes(rows["source"]), _codes(rows["cluster"]))), capacity)
        rows["bin"] = [f"{shard}-{b}" for shard, b in zip(rows["shard"], bins)]
        rows["residual"] = capacity - rows.groupby("bin")["n_tokens"].transform("sum")
        return rows[["row_id", "piece", "first_token", "n_tokens", "bin", "residual"]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster=None, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: row_id, piece, first_token, n_tokens, bin, residual (of the bin).

    Tokens are words between ASCII white space.  ``cluster`` is a Column; by default
    equal texts are a cluster.  Null sources and clusters conflict with nothing, null
    ids are packed like others, texts without a token take no bin and give no row, and
    repeated rows never share a bin."""
    text = F.col(text_col).cast("string")
    sized = docs.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.xxhash64(text) if cluster is None else cluster).alias("cluster"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64(F.col(id_col), text, F.monotonically_increasing_id()).alias("_deal"),
    ).where("tokens > 0")
    sized = written(sized, "sizes")  # texts are scanned once
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    shards = max(1, -(-total["n"] // shard_tokens), -(-total["rows"] // SHARD_ROWS))
    last = F.floor((F.col("tokens") - 1) / capacity)
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("p")).select(
        F.pmod(F.xxhash64("_deal", "p"), F.lit(shards)).cast("int").alias("shard"),
        "row_id",
        "source",
        "cluster",
        F.col("p").cast("int").alias("piece"),
        (F.col("p") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("p") * capacity).alias("n_tokens"),
    )
    return pieces.groupBy("shard").applyInPandas(_pack_shard(capacity), PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins; texts without a token give no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).withColumnRenamed("row_id", "doc_id")
