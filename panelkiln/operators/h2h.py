"""Head-to-head and home/away aggregates (A-1 to A-9).

Two branches, joined by pair: totals are summed before their shuffle, and last-n columns
see only the newest rows of each pair, which Spark cuts to before the shuffle as well, so a
pair that holds a third of all rows is no large task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .lineage import once

RECENT = 5
FEW = 50_000


def _total(c: Column, present: Column) -> Column:
    """A sum that is 0 if rows are there but all null, and null without rows."""
    return F.when(F.count(F.when(present, 1)) > 0, F.coalesce(F.sum(F.when(present, c)), F.lit(0)))


def first_rows(rows: DataFrame, group, order, n: int, newest: bool = False, few: bool = False) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, or the newest (nulls last), with their
    number in ``_rank``.

    With ``few`` groups, as of teams, rows are counted by group and first column of the order
    beforehand, and only rows are sorted whose value may hold one of the ``n``, so no task
    sorts all that it reads.  If these values (n a group at most) are more than ``FEW``, they are not used."""
    at = lambda c: F.col(c).desc_nulls_last() if newest else F.col(c).asc()
    if few and n > 0:
        key = [*group, order[0]]
        before = F.sum("_c").over(Window.partitionBy(*group).orderBy(at(order[0])).rowsBetween(Window.unboundedPreceding, -1))
        counted = rows.groupBy(*key).agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < n)
        values = once(counted.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]))
        if values.count() <= FEW:
            rows = rows.join(F.broadcast(values), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]), "left_semi")
    w = Window.partitionBy(*group).orderBy(*[at(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)


def _with_newest(rows: DataFrame, pair, venue, order, totals, newest, n: int, few: bool = False) -> DataFrame:
    """``totals`` of all rows of a pair beside ``newest``, aggregates over its ``n`` newest
    rows (of each venue), whose rank is in ``_rank``.  Null keys are keys."""
    whole = rows.groupBy(*pair).agg(*totals)
    if not newest:
        return whole
    last = first_rows(rows, [*pair, *venue], order, n, newest=True, few=few).groupBy(*pair).agg(*newest)
    last = last.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(pair)], *[c for c in last.columns if c not in pair])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(pair)])
    return whole.join(last, same, "left").drop(*[f"_{i}" for i in range(len(pair))])


def head_to_head(df: DataFrame, pair, order, mean=(), sums=(), windows=config.WINDOWS, count_name: str = "appearances", was_home: str | None = None, seasons=None, few: bool = False) -> DataFrame:
    """A-1 and A-4 (with A-2, A-3): per pair avg_{m}, total_{s}, the number of rows,
    {m}_h2h_last_{w}, {s}_h2h_sum_last_{w}, recent_{m}_last_5, recent_{s}_sum_last_5 and,
    with ``was_home``, avg_{m}_home/_away and total_{s}_home/_away.  ``order`` ascends in
    time; rows tied in it are ranked arbitrarily, so it should be total.  ``few``: see ``first_rows``."""
    rows = df.where(F.col("season").isin(list(seasons))) if seasons is not None else df
    yes = F.lit(True)
    totals = [F.avg(m).alias(f"avg_{m}") for m in mean] + [_total(F.col(s), yes).alias(f"total_{s}") for s in sums] + [F.count("*").alias(count_name)]
    if was_home is not None:
        for name, side in (("home", F.col(was_home)), ("away", ~F.col(was_home))):
            totals += [F.avg(F.when(side, F.col(m))).alias(f"avg_{m}_{name}") for m in mean]
            totals += [_total(F.col(s), side).alias(f"total_{s}_{name}") for s in sums]
    newest = []
    for w in windows:
        last = F.col("_rank") <= w
        newest += [F.avg(F.when(last, F.col(m))).alias(f"{m}_h2h_last_{w}") for m in mean]
        newest += [_total(F.col(s), last).alias(f"{s}_h2h_sum_last_{w}") for s in sums]
    recent = F.col("_rank") <= RECENT
    newest += [F.avg(F.when(recent, F.col(m))).alias(f"recent_{m}_last_{RECENT}") for m in mean]
    newest += [_total(F.col(s), recent).alias(f"recent_{s}_sum_last_{RECENT}") for s in sums]
    return _with_newest(rows, pair, [], order, totals, newest, max([RECENT, *windows]), few)


def head_to_head_bundle(player_rows: DataFrame, matches: DataFrame, **options) -> dict[str, DataFrame]:
    """A-5: both tables, lazy."""
    return {
        "player_vs_team": head_to_head(player_rows, **options["player"]),
        "team_h2h": head_to_head(matches, **({"count_name": "total_matches"} | options["team"])),
    }


def player_home_away(df: DataFrame, pair, order, mean=(), sums=(), windows=config.WINDOWS, was_home: str = "was_home") -> DataFrame:
    """A-6: per pair home_avg_{m}, away_avg_{m}, home_total_{s}, ..., appearances by venue
    and {side}_{m}_rolling_{w} over the last w rows at that venue."""
    totals, newest = [], []
    for name, side in (("home", F.col(was_home)), ("away", ~F.col(was_home))):
        totals += [F.avg(F.when(side, F.col(m))).alias(f"{name}_avg_{m}") for m in mean]
        totals += [_total(F.col(s), side).alias(f"{name}_total_{s}") for s in sums]
        totals.append(F.count(F.when(side, 1)).alias(f"{name}_appearances"))
        newest += [F.avg(F.when(side & (F.col("_rank") <= w), F.col(m))).alias(f"{name}_{m}_rolling_{w}") for m in mean for w in windows]
    return _with_newest(df, pair, [was_home], order, totals, newest, max([0, *windows]))


def team_home_away(df: DataFrame, home: str, away: str, order, metrics, windows=config.WINDOWS) -> DataFrame:
    """A-7: per (team, opponent) means of ``metrics`` (pairs of a home and an away column)
    from the home side and, with roles swapped, from the away side; match counts; home
    last-w means.  Both sides are one stacked table and one group, so pairs met at one
    venue only stay."""
    mine = df.select(F.col(home).alias("team"), F.col(away).alias("opponent"), F.lit(True).alias("at_home"), *order, *[F.col(h).alias(f"for_{h}") for h, _ in metrics], *[F.col(a).alias(f"against_{h}") for h, a in metrics])
    other = df.select(F.col(away).alias("team"), F.col(home).alias("opponent"), F.lit(False).alias("at_home"), *order, *[F.col(a).alias(f"for_{h}") for h, a in metrics], *[F.col(h).alias(f"against_{h}") for h, _ in metrics])
    names = [f"{p}_{h}" for h, _ in metrics for p in ("for", "against")]
    totals = []
    for name, side in (("home", F.col("at_home")), ("away", ~F.col("at_home"))):
        totals += [F.avg(F.when(side, F.col(n))).alias(f"{name}_avg_{n}") for n in names]
        totals.append(F.count(F.when(side, 1)).alias(f"{name}_matches"))
    newest = [F.avg(F.when(F.col("at_home") & (F.col("_rank") <= w), F.col(n))).alias(f"home_{n}_rolling_{w}") for n in names for w in windows]
    return _with_newest(mine.unionByName(other), ["team", "opponent"], ["at_home"], order, totals, newest, max([0, *windows]), few=True)


def advantage(df: DataFrame, metrics, floor: float = 0.01) -> DataFrame:
    """A-8: {m}_home_advantage = (home-away)/max(away, floor) and {m}_away_degradation
    = (away-home)/max(home, floor), from home_avg_{m} and away_avg_{m}."""
    at_least = lambda c: F.when(c < floor, floor).otherwise(c)
    new = []
    for m in metrics:
        h, a = F.col(f"home_avg_{m}"), F.col(f"away_avg_{m}")
        new += [((h - a) / at_least(a)).alias(f"{m}_home_advantage"), ((a - h) / at_least(h)).alias(f"{m}_away_degradation")]
    return df.select("*", *new)


def home_away_bundle(player_rows: DataFrame, matches: DataFrame, player: dict, team: dict) -> dict[str, DataFrame]:
    """A-9: A-6 and A-7, each with A-8."""
    players = player_home_away(player_rows, **player)
    teams = team_home_away(matches, **team)
    return {"player": advantage(players, player["mean"]), "team": advantage(teams, [f"for_{h}" for h, _ in team["metrics"]])}
