"""Typing, clamping, flags, winsorising and conforming (P-1 to P-12, P-18 to P-28)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from .quantiles import exact_quantiles
from .sketches import column_sketches, sketch_bounds
from .scan import row_numbers


def conform(df: DataFrame, renames: dict, casts: dict | None = None, literals: dict | None = None, absent: dict | None = None) -> DataFrame:
    """P-1 to P-6: rename and cast columns where present, add literals, and add columns of
    a schema that are absent as nulls of a type."""
    df = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})
    new = {c: F.col(c).try_cast(t) for c, t in (casts or {}).items() if c in df.columns}
    new |= {c: F.lit(v) for c, v in (literals or {}).items()}
    new |= {c: F.lit(None).cast(t) for c, t in (absent or {}).items() if c not in df.columns}
    return df.withColumns(new) if new else df


def by_crosswalk(df: DataFrame, crosswalk: DataFrame, source_id: str, target_id: str, into: str = "player_id") -> DataFrame:
    """P-2: ids mapped, unmatched rows dropped, ``gameweek`` null if absent."""
    out = df.join(crosswalk.select(F.col(source_id), F.col(target_id).alias("_to")).where("_to is not null").dropDuplicates([source_id]), source_id)
    out = out.drop(source_id, *([into] if into in df.columns else [])).withColumnRenamed("_to", into)
    return out if "gameweek" in out.columns else out.withColumn("gameweek", F.lit(None).cast("long"))


def stack_sources(frames: dict[str, DataFrame], columns: dict[str, str], key: str) -> DataFrame:
    """P-3: frames cut to one schema, absent columns null, a ``source`` literal, no null keys."""
    parts = [conform(df, {}, columns, {"source": name}, columns).select(*columns, "source").where(F.col(key).isNotNull()) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def split_columns(df: DataFrame, keys, groups: dict[str, list[str]]) -> dict[str, DataFrame]:
    """P-4, P-5: several tables from one frame."""
    return {name: df.select(*keys, *[c for c in columns if c in df.columns]) for name, columns in groups.items()}


def whitelist(df: DataFrame, allowed) -> DataFrame:
    """SRC-19: the allowed columns that exist."""
    return df.select(*[c for c in allowed if c in df.columns])


def in_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """P-7: rows whose key is in a table of valid ids."""
    return df.join(ids.select(key), key, "left_semi")


def clean_numeric(df: DataFrame, ints=(), floats=()) -> DataFrame:
    """P-10: listed columns as int or double, unparseable values null."""
    new = {c: F.col(c).try_cast("int") for c in ints if c in df.columns} | {c: F.col(c).try_cast("double") for c in floats if c in df.columns}
    return df.withColumns(new) if new else df


def clamp(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """P-11: values below or above their bounds (None: open) become the bound; null stays."""
    new = {}
    for c, (low, high) in bounds.items():
        if c in df.columns:
            v = F.col(c)
            v = F.when(v < low, low).otherwise(v) if low is not None else v
            new[c] = F.when(F.col(c) > high, high).otherwise(v) if high is not None else v
    return df.withColumns(new) if new else df


def quality_flags(df: DataFrame, critical) -> DataFrame:
    """P-12: data_quality_score (share of non-null columns, half-even to 3 digits),
    is_incomplete and missing_fields of the critical columns."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in df.columns])
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() if c in df.columns else F.lit(True), F.lit(c)) for c in critical]))
    return df.select("*", F.bround(filled / F.lit(len(df.columns)), 3).alias("data_quality_score"), (F.size(missing) > 0).alias("is_incomplete"), missing.alias("missing_fields"))


def no_nan(df: DataFrame, columns=None) -> DataFrame:
    """P-20: NaN as 0 in floating columns; null stays."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(0.0)) for c in floats}) if floats else df


def fill_zero(df: DataFrame, columns) -> DataFrame:
    """P-19."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns if c in df.columns})


def winsorize(df: DataFrame, columns, lower: float = 0.01, upper: float = 0.99, method: str = "exact", sketches: DataFrame | None = None) -> DataFrame:
    """P-21: values clipped at quantiles; null stays.  The bounds are one row, broadcast.
    ``method``: "exact" (linear), "nearest" (an element), both from counts by range,
    "approximate" (one aggregate of sketches for all columns), or "sketch" (mergeable
    sketches of all columns in one pass, or the stored ``sketches``, for which ``df`` is not
    read a second time)."""
    if method == "sketch":
        bounds = [sketch_bounds(column_sketches(df, columns) if sketches is None else sketches, columns, [lower, upper])]
    elif method == "approximate":
        bounds = [df.agg(*[F.percentile_approx(c, [lower, upper], 10000).alias(f"_q_{c}") for c in columns])]
    else:
        bounds = [exact_quantiles(df, c, [lower, upper], into=f"_q_{c}", linear=method != "nearest") for c in columns]
    d = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), bounds, df)
    new = {c: F.when(F.col(c) < F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[0]).when(F.col(c) > F.col(f"_q_{c}")[1], F.col(f"_q_{c}")[1]).otherwise(F.col(c)) for c in columns}
    return d.withColumns(new).drop(*[f"_q_{c}" for c in columns])


def clean_data(df: DataFrame, name: str = "name", minutes: str = "minutes", columns=None, contract: dict | None = None, method: str = "exact", sketches: DataFrame | None = None, exclude=()) -> tuple[DataFrame, DataFrame]:
    """P-22: names, minutes, outliers (``method`` and ``sketches`` as in P-21) of ``columns``,
    else of all metrics but those excluded; and the contract's violations (V-7) as rows."""
    from .metrics import resolve_metrics
    from .quality import contract_violations

    d = df.withColumn(name, names.simple_name(F.col(name))) if name in df.columns else df
    d = fill_zero(d, [minutes])
    mean, sums = resolve_metrics(d, exclude=exclude)
    d = winsorize(d, columns or sorted({*mean, *sums}), method=method, sketches=sketches) if (columns or mean or sums) else d
    return d, contract_violations(d, contract)


def prefer_first(df: DataFrame, picks: dict[str, list[str]], required: str | None = None) -> DataFrame:
    """P-25: the first non-null of columns that exist; rows without ``required`` dropped."""
    new = {into: F.coalesce(*[F.col(c) for c in options if c in df.columns]) for into, options in picks.items() if any(c in df.columns for c in options)}
    out = df.withColumns(new)
    return out.where(F.col(required).isNotNull()) if required else out


def heuristic_prediction(df: DataFrame, points: str, xg: str, start_prob: float = 0.8, version: str = "heuristic") -> DataFrame:
    """P-27: 0.6 points + 0.4 xG of the last three, a constant start probability, a tag."""
    return df.select("*", (F.col(points) * 0.6 + F.col(xg) * 0.4).alias("predicted_points"), F.lit(start_prob).alias("start_probability"), F.lit(version).alias("model_version"))


def match_ordinal(df: DataFrame, season: str, order) -> DataFrame:
    """W-17: the ordinal of a match in its season."""
    return row_numbers(df, order, [season], "match_ordinal").withColumn("match_ordinal", F.col("match_ordinal").cast("int"))


def null_if(c: Column, *values) -> Column:
    return F.when(~c.isin(*values), c)
