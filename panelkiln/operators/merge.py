"""Merges, lookups, keyed dedupe and set operations (J-1 to J-7, J-19 to J-27, W-8, W-9, W-11, U-*, A-18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def merge_left(base: DataFrame, *others: tuple[DataFrame, list[str]]) -> DataFrame:
    """J-1, J-2, J-19: left joins on named keys; a frame without its keys is skipped."""
    for other, on in others:
        if set(on) <= set(base.columns) and set(on) <= set(other.columns):
            clash = [c for c in other.columns if c in base.columns and c not in on]
            base = base.join(other.drop(*clash), on, "left")
    return base


def unified_periods(a: DataFrame, b: DataFrame, c: DataFrame, keys, info: DataFrame | None = None, info_key: str | None = None, suffixes=("_a", "_b", "_c")) -> DataFrame:
    """J-3: full outer join of three conformed tables on coalesced keys; columns that
    several have get their source's suffix."""
    shared = {x for d, e in ((a, b), (a, c), (b, c)) for x in set(d.columns) & set(e.columns)} - set(keys)
    parts = [d.withColumnsRenamed({x: x + s for x in d.columns if x in shared}) for d, s in zip((a, b, c), suffixes)]
    out = reduce(lambda x, y: x.join(y, list(keys), "full_outer"), parts)
    return merge_left(out, (info, [info_key])) if info is not None else out


def resolve_ids(df: DataFrame, mapping: DataFrame, on: dict[str, str], take: dict[str, str], how: str = "left") -> DataFrame:
    """J-4: ids by lookup: ``on`` maps columns of ``df`` to the mapping's, ``take`` new
    columns to the mapping's.  The first id (least) of a repeated key counts."""
    m = mapping.groupBy(*[F.col(k).alias(f"_k_{k}") for k in on.values()]).agg(*[F.min(v).alias(f"_t_{n}") for n, v in take.items()])
    cond = reduce(lambda a, b: a & b, [df[l] == F.col(f"_k_{r}") for l, r in on.items()])
    d = df.join(m, cond, how)
    return d.select(*[df[c] for c in df.columns if c not in take], *[F.col(f"_t_{n}").alias(n) for n in take])


def resolve_any(df: DataFrame, mapping: DataFrame, ids, by, key: str, take: str, into: str) -> DataFrame:
    """J-5: the id by any of several id columns of the mapping, in one stacked lookup."""
    stacked = reduce(DataFrame.unionByName, [mapping.select(*by, F.col(i).alias("_id"), F.col(take).alias("_t"), F.lit(k).alias("_o")) for k, i in enumerate(ids)])
    one = stacked.where("_id is not null").groupBy(*by, "_id").agg(F.min_by("_t", F.struct("_o", "_t")).alias("_t"))
    return df.join(one.withColumnRenamed("_id", key), [*by, key], "left").withColumnRenamed("_t", into)


def fill_from_lookup(df: DataFrame, lookup: DataFrame, on, target: str, value: str) -> DataFrame:
    """J-6: a column filled from a lookup only where it is null."""
    one = lookup.groupBy(*on).agg(F.min(value).alias("_v"))
    return df.join(one, list(on), "left").withColumn(target, F.coalesce(target, "_v")).drop("_v").select(*df.columns)


def unified_stats(base: DataFrame, other: DataFrame, keys, columns, minutes: str = "minutes") -> DataFrame:
    """J-7: rows of either source; the other source's non-null values win; minutes are the
    larger if the base has any, else the other's; rows without a key go."""
    has = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    a = base.where(has).withColumnsRenamed({c: f"_a_{c}" for c in base.columns if c not in keys})
    b = other.where(has).withColumnsRenamed({c: f"_b_{c}" for c in other.columns if c not in keys})
    d = a.join(b, list(keys), "full_outer")
    out = []
    for c in columns:
        x, y = (F.col(f"{p}_{c}") if f"{p}_{c}" in d.columns else F.lit(None) for p in ("_a", "_b"))
        if c == minutes:
            out.append(F.when(x > 0, F.greatest(x, y)).otherwise(F.coalesce(y, x)).alias(c))
        else:
            out.append(F.coalesce(y, x).alias(c))
    return d.select(*keys, *out)


def keep_best(df: DataFrame, keys, score: str | None = None, sequence=()) -> DataFrame:
    """W-8, W-9: one row per key: highest score (null as 0), the first of ties by
    ``sequence``; the last by ``sequence`` without a score.  Rows with a null key go."""
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    by = [F.coalesce(F.col(score), F.lit(0)).desc(), *sequence] if score else [F.col(c).desc_nulls_last() for c in sequence]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_r = 1").drop("_r")


def sql_dedupe(df: DataFrame, keys, order) -> DataFrame:
    """W-11: the first row per key by ``order`` (Columns), null keys dropped."""
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest(df: DataFrame, key, at: str, columns) -> DataFrame:
    """A-18: columns of each key's latest row."""
    s = F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("_s")
    return df.groupBy(*key).agg(s).select(*key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def last_mean(df: DataFrame, key, order, metrics, n: int = 3, period: str | None = None) -> DataFrame:
    """A-19: mean of each key's last n rows, and the next period."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    r = df.withColumn("_r", F.row_number().over(w))
    out = [F.avg(F.when(F.col("_r") <= n, F.col(m))).alias(f"{m}_last_{n}") for m in metrics]
    return r.groupBy(*key).agg(*out, *([(F.max(period) + 1).alias(f"next_{period}")] if period else []))


def fill_missing(main: DataFrame, other: DataFrame, on, value=0) -> DataFrame:
    """J-20: left join, absent numbers 0."""
    new = [c for c in other.columns if c not in on]
    d = main.join(other, list(on), "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in new})


def rebuild_fixtures(rows: DataFrame, fixture=("season", "fixture"), team: str = "team", was_home: str = "was_home", extra=("kickoff_time",)) -> DataFrame:
    """J-22: a fixture's home and away team from its players' rows, in one group; fixtures
    seen from one side only go.  Disagreeing rows: the greatest name."""
    h = F.col(was_home)
    g = rows.groupBy(*fixture).agg(F.max(F.when(h, F.col(team))).alias("home_team"), F.max(F.when(~h, F.col(team))).alias("away_team"), *[F.max(c).alias(c) for c in extra])
    return g.where("home_team is not null and away_team is not null")


def enrich_players(rows: DataFrame, teams: DataFrame, by, team_key: str = "team", position_type: str | None = None) -> DataFrame:
    """J-27: position from its type, team name by join and normalised, one row per ``by``
    (the least of the others)."""
    one = teams.groupBy(F.col("id").alias("_tid")).agg(F.min("name").alias("_tn"))
    d = rows.join(one, F.col(team_key) == F.col("_tid"), "left")
    d = d.withColumn("team_name", N.team_name(F.col("_tn"))).drop("_tid", "_tn")
    d = d.withColumn("position", N.element_type(F.col(position_type))) if position_type else d
    rest = [c for c in d.columns if c not in by]
    return d.groupBy(*by).agg(F.min(F.struct(*rest)).alias("_s")).select(*by, *[F.col(f"_s.{c}").alias(c) for c in rest])


def rosters(matches: DataFrame, player: str, team: str, season: str = "season") -> tuple[DataFrame, DataFrame]:
    """U-7: distinct players with team, and distinct teams, of all seasons at once."""
    return matches.select(season, player, team).distinct(), matches.select(season, team).distinct()


def diagonal(*frames: DataFrame) -> DataFrame:
    """U-1: columns united, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_by(df: DataFrame, keys, order) -> DataFrame:
    """U-3 with a stated order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_n(df: DataFrame, keys, order, n: int) -> DataFrame:
    """T-5."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def new_keys(df: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """U-6."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def bonus(df: DataFrame, match: str, score: str, sequence) -> DataFrame:
    """W-16: 3, 2 and 1 points for a match's best three."""
    r = F.row_number().over(Window.partitionBy(match).orderBy(F.col(score).desc_nulls_last(), *sequence))
    return df.withColumn("bonus", F.when(r <= 3, 4 - r).otherwise(0))
