"""Validation and monitoring (V-1 to V-10, A-14 to A-17, A-21 to A-23, SRC-20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "check string, severity string, subject string, rows long"


def schema_issues(df: DataFrame, expected: dict[str, str]) -> list[tuple]:
    """V-1: missing columns are errors, other types warnings; no job runs."""
    have = dict(df.dtypes)
    missing = [("schema", "error", c, 0) for c in expected if c not in have]
    return missing + [("schema", "warning", c, 0) for c, t in expected.items() if c in have and have[c] != t]


def range_checks(ranges: dict[str, tuple]) -> list[tuple[str, str, str, Column]]:
    """V-2: (check, severity, subject, flag) of values outside their bounds; null passes."""
    out = []
    for c, (low, high) in ranges.items():
        below = F.col(c) < low if low is not None else F.lit(False)
        above = F.col(c) > high if high is not None else F.lit(False)
        out.append(("range", "error", c, F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))))
    return out


def implies(name: str, when: Column, then: Column) -> tuple:
    return ("implies", "warning", name, F.coalesce(when, F.lit(False)) & ~F.coalesce(then, F.lit(False)))


def sum_check(name: str, parts, total: str, tolerance: float = 0.01) -> tuple:
    whole = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return ("sum_check", "warning", name, F.coalesce(F.abs(whole - F.col(total)) > tolerance, F.lit(False)))


def non_negative(column: str) -> tuple:
    return ("non_negative", "error", column, F.coalesce(F.col(column) < 0, F.lit(False)))


def completeness(df: DataFrame) -> DataFrame:
    """V-4: (column, ratio) of non-null values; 1 for an empty table."""
    n = F.count("*")
    rows = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.when(n == 0, 1.0).otherwise(F.count(c) / n).alias("ratio")) for c in df.columns]).alias("r"))
    return rows.select(F.inline("r"))


def duplicate_rows(df: DataFrame, keys, ignore_null: bool = False) -> DataFrame:
    """V-5 and A-16: one row with the rows in duplicate groups and the surplus rows."""
    d = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if ignore_null else df
    n = d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"), F.count("*").alias("duplicate_keys"))


def contract_violations(df: DataFrame, contract: dict | None = None) -> DataFrame:
    """V-7: (column, rows) that break the bounds of a contract, for columns that exist."""
    default = {"player_id": (1, None), "gameweek": (1, 38), "minutes": (0, None), "goals_scored": (0, None), "assists": (0, None), "total_points": (None, None)}
    flags = range_checks({c: b for c, b in (contract or default).items() if c in df.columns})
    if not flags:
        return df.sparkSession.createDataFrame([], "column string, rows long")
    one = df.agg(F.array(*[F.struct(F.lit(s).alias("column"), F.count_if(f).alias("rows")) for _, _, s, f in flags]).alias("r"))
    return one.select(F.inline("r"))


def run_validation(df: DataFrame, expected: dict | None = None, checks=(), critical=(), complete: float = 0.95, unique=()) -> DataFrame:
    """V-6: rows of (check, severity, subject, rows); a check that passes has severity
    ``passed``.  Row checks and completeness are one pass, each unique key one group."""
    spark = df.sparkSession
    parts = [spark.createDataFrame(schema_issues(df, expected or {}), ISSUE)]
    n = F.count("*")
    entries = [(k, s, x, F.count_if(f), F.count_if(f) > 0) for k, s, x, f in checks]
    for c in df.columns:
        least, severity = (1.0, "error") if c in critical else (complete, "warning")
        entries.append(("completeness", severity, c, n - F.count(c), (n > 0) & (F.count(c) < least * n)))
    made = [F.struct(F.lit(k).alias("check"), F.when(bad, s).otherwise("passed").alias("severity"), F.lit(x).alias("subject"), rows.alias("rows")) for k, s, x, rows, bad in entries]
    parts.append(df.agg(F.array(*made).alias("r")).select(F.inline("r")))
    for keys in unique:
        d = duplicate_rows(df, keys)
        parts.append(d.select(F.lit("unique").alias("check"), F.when(F.col("duplicate_rows") > 0, "error").otherwise("passed").alias("severity"), F.lit(",".join(keys)).alias("subject"), F.col("duplicate_rows").alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def is_valid(report: DataFrame) -> DataFrame:
    """Severity counts of a report and its validity, one row."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return report.agg(count("error").alias("errors"), count("warning").alias("warnings"), count("passed").alias("passed"), (count("error") == 0).alias("is_valid"))


def is_fresh(df: DataFrame, required=(), min_rows: int = 1) -> bool:
    """V-8: required columns and at least ``min_rows`` rows; stops counting there."""
    return set(required) <= set(df.columns) and df.limit(min_rows).count() >= min_rows


def freshness(df: DataFrame, required=(), **least: int) -> DataFrame:
    """V-8 as a lazy table of one row: whether the required columns and so many rows are
    there, one column for each of ``least``."""
    whole = set(required) <= set(df.columns)
    return df.agg(*[(F.lit(whole) & (F.count("*") >= n)).alias(name) for name, n in least.items()])


def orphans(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """V-10: the number of non-null keys that the other table lacks, one row.

    Rows are counted by key before their shuffle, so a key travels once a task, however many
    rows hold it, and no key is hot in the join."""
    known = other.select(F.col(other_key or key).alias(key))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    return counts.join(known, key, "left_anti").agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"))


def mapping_quality(mapping: DataFrame, ids, season: str = "season", confidence: str = "confidence_score", high: float = 0.85) -> DataFrame:
    """A-14: per season and in total (null season) rows, those with each id, pairs of ids,
    rates in percent to one decimal and rows of high confidence."""
    have = {i: F.col(i).isNotNull() for i in ids}
    n = F.count("*")
    out = [n.alias("total")] + [F.count_if(h).alias(f"with_{i}") for i, h in have.items()]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    out += [F.count_if(have[a] & have[b]).alias(f"with_{a}_and_{b}") for a, b in pairs]
    out += [F.round(F.count_if(h) / n * 100, 1).alias(f"rate_{i}") for i, h in have.items()]
    out += [F.count_if(F.col(confidence) >= high).alias("high_confidence"), F.grouping(season).cast("int").alias("is_total")]
    return mapping.rollup(season).agg(*out)


def coverage(mapping: DataFrame, ids, season: str = "season") -> DataFrame:
    """A-21: rows, rows with each id and rows with two ids or more, per season and in total."""
    several = reduce(lambda a, b: a + b, [F.col(i).isNotNull().cast("int") for i in ids]) >= 2
    n = F.count("*")
    return mapping.rollup(season).agg(n.alias("total"), *[F.count(i).alias(f"with_{i}") for i in ids], F.count_if(several).alias("with_several"), F.round(F.count_if(several) / n * 100, 1).alias("rate"), F.grouping(season).cast("int").alias("is_total"))


def row_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """A-15: (table_name, rows); -1 for a missing table."""
    spark = next(d for d in tables.values() if d is not None).sparkSession
    one = [d.agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) if d is not None else spark.range(1).select(F.lit(t).alias("table_name"), F.lit(-1).cast("long").alias("rows")) for t, d in tables.items()]
    return reduce(DataFrame.unionByName, one)


def season_histogram(tables: dict[str, DataFrame], season: str = "season") -> DataFrame:
    """A-23."""
    return reduce(DataFrame.unionByName, [d.groupBy(season).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), season, "rows") for t, d in tables.items()])


def all_metrics(tables: dict, mapping: DataFrame, ids, season: str = "season") -> DataFrame:
    """A-17 = A-14 + A-15 + A-16 as (metric, season, value)."""
    q = mapping_quality(mapping, ids, season)
    names = [c for c in q.columns if c not in (season, "is_total")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    part = q.select(F.when(F.col("is_total") == 1, "total").otherwise(F.col(season)).alias("season"), F.inline(pairs)).select("metric", "season", "value")
    counts = row_counts(tables).select(F.concat(F.lit("rows_"), "table_name").alias("metric"), F.lit(None).cast("string").alias("season"), F.col("rows").cast("double").alias("value"))
    doubled = reduce(DataFrame.unionByName, [duplicate_rows(mapping, [season, i], True).select(F.lit(f"duplicates_{i}").alias("metric"), F.lit(None).cast("string").alias("season"), F.col("surplus_rows").cast("double").alias("value")) for i in ids])
    return part.unionByName(counts).unionByName(doubled)


def date_overlap(frames: dict[str, DataFrame], season: str, date: str) -> DataFrame:
    """A-22: per season the dates of each source and those shared by pairs and by all."""
    names = list(frames)
    flags = [d.select(season, date, *[F.lit(n == m).alias(m) for m in names]) for n, d in frames.items()]
    per_day = reduce(DataFrame.unionByName, flags).groupBy(season, date).agg(*[F.bool_or(m).alias(m) for m in names])
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    every = reduce(lambda a, b: a & b, [F.col(m) for m in names])
    return per_day.groupBy(season).agg(*[F.count_if(F.col(m)).alias(f"dates_{m}") for m in names], *[F.count_if(F.col(a) & F.col(b)).alias(f"shared_{a}_{b}") for a, b in pairs], F.count_if(every).alias("shared_all"))


HASH_SEEDS = (1, 2)


def fingerprint(df: DataFrame, by) -> DataFrame:
    """SRC-20: order-free content hash and row count per group.

    The hash is that of a multiset: two independent row hashes are summed modulo 2**64 (in
    halves, as decimals), so a row counts as often as it occurs, and fingerprints of parts
    add up (``combined``)."""
    sums = []
    for seed in HASH_SEEDS:
        h = F.xxhash64(F.lit(seed), *df.columns)
        sums += [F.sum(F.shiftrightunsigned(h, 32).cast("decimal(20,0)")).alias(f"_high{seed}"), F.sum(h.bitwiseAND(0xFFFFFFFF).cast("decimal(20,0)")).alias(f"_low{seed}")]
    return _content(df.groupBy(*by).agg(*sums, F.count("*").alias("row_count")), by)


def _content(sums: DataFrame, by) -> DataFrame:
    """The sums of each seed modulo 2**64, as text."""
    whole = lambda seed: (F.col(f"_high{seed}") % (1 << 32) * F.lit(1 << 32).cast("decimal(20,0)") + F.col(f"_low{seed}")) % F.lit("18446744073709551616").cast("decimal(20,0)")
    return sums.select(*by, F.concat_ws(":", *[whole(s).cast("decimal(20,0)").cast("string") for s in HASH_SEEDS]).alias("content_hash"), "row_count")


def combined(parts: DataFrame, by) -> DataFrame:
    """SRC-20: the fingerprints of groups from those of disjoint parts of their rows, such as
    what was known and what is new."""
    piece = lambda k: F.element_at(F.split("content_hash", ":"), k + 1).cast("decimal(20,0)")
    sums = [F.sum(piece(k)).alias(f"_low{s}") for k, s in enumerate(HASH_SEEDS)]
    summed = parts.groupBy(*by).agg(*sums, F.sum("row_count").alias("row_count"))
    return _content(summed.withColumns({f"_high{s}": F.lit(0).cast("decimal(20,0)") for s in HASH_SEEDS}), by)


def changes(now: DataFrame, before: DataFrame, by) -> DataFrame:
    """SRC-20: groups that are new, gone or changed between two fingerprints."""
    b = before.select(*by, F.col("content_hash").alias("_h"), F.col("row_count").alias("_n"))
    d = now.join(b, list(by), "full_outer")
    kind = F.when(F.col("_n").isNull(), "new").when(F.col("row_count").isNull(), "gone").when((F.col("content_hash") != F.col("_h")) | (F.col("row_count") != F.col("_n")), "changed")
    return d.select(*by, kind.alias("change")).where("change is not null")
