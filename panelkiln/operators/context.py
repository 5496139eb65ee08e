"""Fixture, rest, availability and load features (W-5, W-6, F-1 to F-4, A-10 to A-13, A-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import h2h, scan


def days_since_last(df: DataFrame, keys, at: str, into: str = "days_since_last_match", tie=()) -> DataFrame:
    """W-5: whole days since the entity's row before; null for the first."""
    w = Window.partitionBy(*keys).orderBy(at, *tie)
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    return df.withColumn(into, F.floor((t - F.lag(t).over(w)) / 86400))


def matches_within(df: DataFrame, keys, at: str, days=(7, 14, 30), prefix: str = "") -> DataFrame:
    """W-6: {prefix}matches_last_{d}d, the rows of the last d days with the row itself; of a
    row without a time, the rows without one.  Counts up to the row less counts up to what is
    too old: a frame with two moving ends is counted anew for every row."""
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(t)
    upto = lambda end: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, end))
    old = lambda d: F.when(t.isNull(), F.lit(0)).otherwise(upto(-d * 86400 - 1))
    return df.select("*", *[(upto(Window.currentRow) - old(d)).cast("long").alias(f"{prefix}matches_last_{d}d") for d in days])


def rest_and_fatigue(df: DataFrame, player_keys=("player_id",), team_keys=("team",), at: str = "kickoff_time", tie=()) -> DataFrame:
    """F-2; without the date column the input comes back.  A team's rows may exceed a task,
    so its counts are taken by sections.  ``tie`` orders a player's rows of one time."""
    if at not in df.columns:
        return df
    parsed = df.withColumn(at, F.try_to_timestamp(F.col(at).cast("string")))
    teams = {f"team_matches_last_{d}d": d * 86400 for d in (7, 14)}
    counted = scan.counts_within(parsed.withColumn("_s", F.unix_seconds(at)), "_s", teams, team_keys).drop("_s")
    made = matches_within(days_since_last(counted, player_keys, at, tie=tie), player_keys, at)
    return made.select(*[c for c in made.columns if c not in teams], *teams)


def fatigue_factor(rest_days: Column) -> Column:
    """D-6: 1 - 0.1 for each day of rest below three, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (3 - rest_days) * 0.1))


def fixture_difficulty(fixtures: DataFrame, teams: DataFrame | None = None, given=("team_h_difficulty", "team_a_difficulty"), home: str = "home_team_id", away: str = "away_team_id") -> DataFrame:
    """F-1: home_difficulty, away_difficulty, overall_difficulty.  Ratings as supplied,
    else the opponent's strength less (home) or plus (away) one within 1 and 5, else 3.
    ``teams`` (id, strength) is a dimension table."""
    d = fixtures
    names = (F.lit(None).cast("double"), F.lit(None).cast("double"))
    if teams is not None:
        side = lambda key, name: teams.select(F.col("id").alias(key), F.col("strength").cast("double").alias(name)).dropDuplicates([key])
        d = d.join(side(away, "_opp_h"), away, "left").join(side(home, "_opp_a"), home, "left")
        clip = lambda c: F.when(c.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(1.0), c)))
        names = (clip(F.col("_opp_h") - 1), clip(F.col("_opp_a") + 1))
    have = [F.col(c).cast("double") if c in fixtures.columns else F.lit(None).cast("double") for c in given]
    h, a = (F.coalesce(x, y, F.lit(3.0)) for x, y in zip(have, names))
    return d.select(*fixtures.columns, h.alias("home_difficulty"), a.alias("away_difficulty"), F.round((h + a) / 2).alias("overall_difficulty"))


def team_strength(teams: DataFrame, matches: DataFrame, home: str = "home_team_id", away: str = "away_team_id", home_goals: str = "home_goals", away_goals: str = "away_goals", home_xg: str = "home_xg", away_xg: str = "away_xg", base=("strength_attack_home", "strength_attack_away")) -> DataFrame:
    """A-10: mean home and away goals and xG of each team; goals fall back to the base
    rating over ten."""
    h = matches.groupBy(F.col(home).alias("id")).agg(F.avg(home_goals).alias("_hg"), F.avg(home_xg).alias("home_xg_mean"))
    a = matches.groupBy(F.col(away).alias("id")).agg(F.avg(away_goals).alias("_ag"), F.avg(away_xg).alias("away_xg_mean"))
    d = teams.join(h, "id", "left").join(a, "id", "left")
    return d.select(*teams.columns, F.coalesce("_hg", F.col(base[0]) / 10).alias("attack_home"), F.coalesce("_ag", F.col(base[1]) / 10).alias("attack_away"), "home_xg_mean", "away_xg_mean")


def strength_of_schedule(fixtures: DataFrame, window: int = 5, order=("gameweek",), home: str = "home_team_id", away: str = "away_team_id", value: str = "overall_difficulty") -> DataFrame:
    """A-11: per team mean difficulty and count of its first ``window`` fixtures at home
    and away, and their mean weighted by the counts (a missing side has weight 0)."""
    stacked = fixtures.select(F.col(home).alias("team"), F.lit(True).alias("at_home"), *order, F.col(value).alias("v")).unionByName(
        fixtures.select(F.col(away).alias("team"), F.lit(False).alias("at_home"), *order, F.col(value).alias("v"))
    )
    first = h2h.first_rows(stacked, ["team", "at_home"], list(order), window, few=True)
    side = F.col("at_home")
    sums = first.groupBy("team").agg(
        F.avg(F.when(side, F.col("v"))).alias("home_difficulty_mean"), F.count(F.when(side, F.col("v"))).alias("home_fixtures"),
        F.avg(F.when(~side, F.col("v"))).alias("away_difficulty_mean"), F.count(F.when(~side, F.col("v"))).alias("away_fixtures"), F.avg("v").alias("schedule_difficulty"),
    )
    return sums


def defensive_totals(fixtures: DataFrame, rows: DataFrame, key: str, was_home: str, metrics) -> DataFrame:
    """A-12: sums of ``metrics`` by venue as team_h_{m} and team_a_{m} on each fixture."""
    side = F.col(was_home)
    sums = rows.groupBy(key).agg(*[F.sum(F.when(s, F.coalesce(F.col(m), F.lit(0)))).alias(f"team_{n}_{m}") for m in metrics for n, s in (("h", side), ("a", ~side))])
    return fixtures.join(sums, key, "left")


# Availability of a status.
AVAILABILITY = {"a": 1.0, "d": 0.5, "i": 0.0, "s": 0.0, "u": 0.0}


def availability(df: DataFrame, team: str = "team", status: str = "status") -> DataFrame:
    """F-3 = P-18 + A-13: is_available, availability_score, team_availability_rate, squad_size."""
    s = F.col(status)
    score = F.lit(0.0)
    for code, value in AVAILABILITY.items():
        score = F.when(s == code, value).otherwise(score)
    ok = F.coalesce(s == "a", F.lit(False))
    squads = df.groupBy(F.col(team).alias("_t")).agg(F.avg(ok.cast("double")).alias("team_availability_rate"), F.count("*").alias("squad_size"))
    rows = df.select("*", ok.alias("is_available"), score.alias("availability_score"))
    return rows.join(squads, F.col(team).eqNullSafe(F.col("_t"))).drop("_t")


def availability_probability(chance: Column, status: Column) -> Column:
    """D-8: the stated chance in percent, else that of the status."""
    return F.coalesce(chance / 100, F.when(status == "a", 1.0).when(status == "d", 0.5).otherwise(0.0))


def international_load(df: DataFrame, load: DataFrame | None, key: str = "player_id", minutes: str = "minutes") -> DataFrame:
    """F-4 = A-20: intl_minutes_total and played_international, 0 without rows."""
    if load is None:
        return df.select("*", F.lit(0).cast("long").alias("intl_minutes_total"), F.lit(0).alias("played_international"))
    sums = load.groupBy(key).agg(F.sum(minutes).alias("_m"))
    return df.join(sums, key, "left").select(*df.columns, F.coalesce("_m", F.lit(0)).cast("long").alias("intl_minutes_total"), (F.coalesce("_m", F.lit(0)) > 0).cast("int").alias("played_international"))


def busy_periods(fixtures: DataFrame, calendar: DataFrame, team: str, period: str) -> DataFrame:
    """D-13: per (team, period) of the calendar the number of fixtures, is_double, is_blank."""
    counts = fixtures.groupBy(team, period).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return calendar.join(counts, [team, period], "left").select(*calendar.columns, n.alias("fixtures"), (n > 1).alias("is_double"), (n == 0).alias("is_blank"))
