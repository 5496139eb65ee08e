"""Ranges of a column, and exact quantiles from counts by range (P-21, P-22, I-2, A-31, A-33)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cuts(df: DataFrame, column: str) -> list[float]:
    """Values that cut a numeric column into a range for each shuffle partition, about
    equal in rows; null and NaN do not count."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    values = df.select(F.col(column).cast("double").alias("_v"))
    return sorted(set(values.stat.approxQuantile("_v", [k / n for k in range(1, n)], 0.25 / n)))


def cell(value: Column, at: list[float]) -> Column:
    """How many of the ascending cuts are below the value (NaN is above all).  Every
    ``step``-th cut is looked at first, then those of one step."""
    if not at:
        return F.lit(0)
    step = max(1, int(len(at) ** 0.5))
    below = lambda c: c < value
    first = F.greatest(F.size(F.filter(F.lit(at[::step]), below)) - 1, F.lit(0)) * step
    return first + F.size(F.filter(F.slice(F.lit(at), first + 1, F.lit(step)), below))


def exact_quantiles(df: DataFrame, column: str, at, by=(), into: str = "quantiles", linear: bool = True) -> DataFrame:
    """(by, into): the quantiles ``at`` of the column's non-null values as doubles, NaN as
    the largest.  ``linear``: between the two ranks next to p (n - 1); else the first value
    that p of the rows do not exceed.  Groups without a value have no row; without ``by``
    there is one row, null for no values.

    Values are counted, counts summed by range, and only ranges that hold a wanted rank are
    sorted, each by itself; no task holds all values of a group."""
    v, g = F.col(column).cast("double"), [f"_g{k}" for k in range(len(by))]
    spans = cuts(df, column)
    counts = df.select(*[F.col(c).alias(n) for c, n in zip(by, g)], v.alias("_v")).where("_v is not null").groupBy(*g, "_v").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_range", cell(F.col("_v"), spans))
    sizes = counts.groupBy(*g, "_range").agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy(*g)
    placed = sizes.withColumns({"_before": F.sum("_size").over(whole.orderBy("_range")) - F.col("_size"), "_all": F.sum("_size").over(whole)})
    ranks = []
    for k, p in enumerate(at):
        if linear:
            place = (F.col("_all") - 1) * F.lit(float(p))
            part = place - F.floor(place)
            ranks += [(k, F.floor(place), 1 - part), (k, F.floor(place) + 1, part)]
        else:
            ranks.append((k, F.greatest(F.ceil(F.col("_all") * F.lit(float(p))) - 1, F.lit(0)), F.lit(1.0)))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("rank"), w.cast("double").alias("weight")) for k, r, w in ranks])
    inside = lambda a: (a.weight > 0) & (a.rank >= F.col("_before")) & (a.rank < F.col("_before") + F.col("_size"))
    wanted = placed.withColumn("_asked", F.filter(asked, inside)).where(F.size("_asked") > 0).select(*[F.col(c).alias(f"_w{c}") for c in g], F.col("_range").alias("_r"), "_before", "_asked")
    same = reduce(lambda a, b: a & b, [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_w{c}")) for c in g]])
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*g, "_range").orderBy("_v"))
    here = lambda a: (a.rank >= F.col("_end") - F.col("_n")) & (a.rank < F.col("_end"))
    hits = counts.join(wanted, same).withColumn("_end", end).select(*g, "_v", F.inline(F.filter("_asked", here)))
    found = hits.groupBy(*g).agg(F.array(*[F.sum(F.when(F.col("k") == k, F.col("weight") * F.col("_v"))) for k in range(len(at))]).alias(into))
    return found.select(*[F.col(n).alias(c) for c, n in zip(by, g)], into)
