"""Imputation (W-7, I-1 to I-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles
from .scan import last_values


def forward_fill(df: DataFrame, columns, order, group=()) -> DataFrame:
    """W-7: the last value before, by ``order``, per group or over the whole table."""
    return last_values(df, columns, order, group)


def _fill(df: DataFrame, stats: dict, group) -> DataFrame:
    """Nulls filled with an aggregate, of the table or of the row's group.  Groups are
    aggregated and joined back; rows of a null group share one."""
    if not group:
        values = df.agg(*[s.alias(f"_s_{c}") for c, s in stats.items()])
        d = df.crossJoin(F.broadcast(values))
    else:
        values = df.groupBy(*group).agg(*[s.alias(f"_s_{c}") for c, s in stats.items()])
        v = values.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[f"_s_{c}" for c in stats])
        on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
        d = df.join(v, on, "left")
    return d.select(*[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in stats else F.col(c) for c in df.columns])


def mean_fill(df: DataFrame, columns, group=()) -> DataFrame:
    """I-1."""
    return _fill(df, {c: F.avg(c) for c in columns}, group)


def median_fill(df: DataFrame, columns, group=(), approximate: bool = False) -> DataFrame:
    """I-2, exact from counts by range; ``approximate`` takes a sketch for each group."""
    if approximate:
        return _fill(df, {c: F.percentile_approx(c, 0.5, 10000) for c in columns}, group)
    d, g = df, [f"_g_{x}" for x in group]
    for c in columns:
        middle = exact_quantiles(df, c, [0.5], group, "_m").select(*[F.col(x).alias(f"_g_{x}") for x in group], F.col("_m")[0].alias(f"_s_{c}"))
        if group:
            d = d.join(middle, reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_g_{x}")) for x in group]), "left").drop(*g)
        else:
            d = d.crossJoin(F.broadcast(middle))  # one row
    return d.select(*[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def mode_fill(df: DataFrame, columns, group=()) -> DataFrame:
    """I-3: the most frequent value, the smallest of ties."""
    return _fill(df, {c: F.mode(c, True) for c in columns}, group)


def constant_fill(df: DataFrame, values: dict) -> DataFrame:
    """I-4."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def run_imputation(df: DataFrame, strategies: dict | None = None, max_null_ratio: float = 0.5, order=(), group=()) -> tuple[DataFrame, DataFrame]:
    """I-5: (imputed, report).  A column's strategy is the given one, else mean for numbers
    and mode for strings; columns with more nulls than ``max_null_ratio`` are left alone.
    The report has column, strategy, nulls_before, nulls_after, rejected."""
    numeric = (T.NumericType,)
    chosen = {}
    for f in df.schema:
        kind = (strategies or {}).get(f.name) or ("mean" if isinstance(f.dataType, numeric) else "mode" if isinstance(f.dataType, T.StringType) else None)
        if kind:
            chosen[f.name] = kind
    profile = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in chosen]).first()
    n = profile["_n"]
    rejected = {c for c in chosen if n and profile[c] / n > max_null_ratio}
    use = {c: k for c, k in chosen.items() if c not in rejected and profile[c]}
    out = df
    for kind, fill in (("mean", mean_fill), ("median", median_fill), ("mode", mode_fill)):
        columns = [c for c, k in use.items() if k == kind]
        out = fill(out, columns, group) if columns else out
    constants = {c: k[1] for c, k in use.items() if isinstance(k, tuple)}
    out = constant_fill(out, constants) if constants else out
    forward = [c for c, k in use.items() if k == "forward"]
    out = forward_fill(out, forward, order, group) if forward else out
    after = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in chosen]) if chosen else None
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k if isinstance(k, str) else "constant").alias("strategy"), F.lit(profile[c]).cast("long").alias("nulls_before"), F.col(c).alias("nulls_after"), F.lit(c in rejected).alias("rejected")) for c, k in chosen.items()])
    report = after.select(F.inline(rows)) if chosen else df.sparkSession.createDataFrame([], "column string, strategy string, nulls_before long, nulls_after long, rejected boolean")
    return out, report
