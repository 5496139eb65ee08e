"""Quantile sketches that are stored by period and merged (P-21, P-22, I-2).

A table of sketches has the columns ``by``, column, sketch: Spark's KLL sketch of the
column's values in that group.  A daily run sketches its new rows only and merges them into
the stored table; bounds over any set of periods come from merged sketches, without the rows.
Sketches only grow: where rows are taken back, their period is sketched again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 1024  # size of a sketch: about 25 kB


def rank_error(k: int = K) -> float:
    """The distance of ranks, as a share of the rows, that a sketch keeps to at 99 %."""
    return 2.296 / k**0.9723


def column_sketches(df: DataFrame, columns, by=(), k: int = K) -> DataFrame:
    """(by, column, sketch) of numeric columns, all in one pass and one exchange of sketches.

    Null and NaN do not count; a group without a value has an empty sketch.  A null group is
    a group.  Without ``by`` there is one group, also of an empty table."""
    if {"column", "sketch"} & {*by}:
        raise ValueError("groups may not be called column or sketch")
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    wide = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(value(c), k).alias(f"_s{i}") for i, c in enumerate(columns)])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)])))


def merged(sketches: DataFrame, by=()) -> DataFrame:
    """(by, column, sketch): sketches of the same ``by`` and column as one."""
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def add_rows(stored: DataFrame, rows: DataFrame, columns, by=(), k: int = K) -> DataFrame:
    """The stored sketches with those of new rows; other rows are not read."""
    return merged(stored.unionByName(column_sketches(rows, columns, by, k)), by)


def sketch_quantiles(sketches: DataFrame, at, by=()) -> DataFrame:
    """(by, column, n, quantiles): values whose ranks are those of ``at`` within
    ``rank_error``; null where no value was seen.  Quantiles 0 and 1 are exact."""
    d = merged(sketches, by).withColumn("n", F.kll_sketch_get_n_double("sketch"))
    found = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in at])
    return d.select(*by, "column", "n", F.when(F.col("n") > 0, found).alias("quantiles"))


def sketch_bounds(sketches: DataFrame, columns, at, prefix: str = "_q_") -> DataFrame:
    """One row: an array of the quantiles ``at`` for each column over all its sketches."""
    q = sketch_quantiles(sketches, at)
    return q.agg(*[F.first(F.when(F.col("column") == c, F.col("quantiles")), True).alias(f"{prefix}{c}") for c in columns])
