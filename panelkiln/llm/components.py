"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SALTS = 64  # parts of a node with many edges
HELD = 200_000  # edges that a task joins before it hands them on


def with_least(df: DataFrame, key: str, value: str, by: str, into: str) -> DataFrame:
    """``df`` with the least ``value`` of all rows of its ``key``.  No task holds a key: its
    rows are dealt to ``SALTS`` parts by ``by``, and only the minima of the parts meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias(into))
    whole = parts.withColumn(into, F.min(into).over(Window.partitionBy(key)))
    return salted.join(whole, [key, "_salt"]).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, "u", "v", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = with_least(down, "u", "v", "v", "m").select("u", "v", F.least("u", "m").alias("m"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))


def _joined(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes, from each node of a task to the least that the task
    knows to be joined with it."""

    def run(batches):
        parent: dict = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars():
            rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield stars()
        yield stars()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the
    least node reachable.  Self edges and edges with a null end are ignored; without
    edges the result is empty, repeated edges count once.  Nodes with many edges are split;
    each round ends in a written table."""
    found = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    current = written(_joined(found).distinct(), "edges")
    mark = _mark(current)
    for _ in range(max_rounds):
        current = written(_small_star(_large_star(current)).where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first())
