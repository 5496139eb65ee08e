"""Scoring rules as Column expressions (P-23, P-24, D-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _by_position(position: Column, table: dict, other: int) -> Column:
    out = F.lit(other)
    for code, value in table.items():
        out = F.when(position == code, value).otherwise(out)
    return out


def points(position: Column, s: dict) -> Column:
    """P-23: points of a stats row, 0 at least.  ``s`` maps event names to Columns; absent
    and null ones count 0."""
    get = lambda k: F.coalesce(s[k].cast("int"), F.lit(0)) if k in s else F.lit(0)
    minutes, back = get("minutes"), position.isin("GK", "DEF")
    total = F.when(minutes >= 60, 2).when(minutes > 0, 1).otherwise(0)
    total += get("goals") * _by_position(position, config.GOAL_POINTS, config.OTHER_GOAL_POINTS)
    total += F.when((get("clean_sheet") > 0) & (minutes >= 60), _by_position(position, config.CLEAN_SHEET_POINTS, 0)).otherwise(0)
    total += F.when(back, -get("goals_conceded")).otherwise(0) + F.when(position == "GK", F.floor(get("saves") / 3)).otherwise(0)
    for name, weight in config.POINTS.items():
        value = F.when(get(name) > 0, 1).otherwise(0) if name.startswith("penalty") else get(name)
        total += value * weight
    return F.greatest(F.lit(0), total).cast("long")


def bps(s: dict) -> Column:
    """P-24: bonus system score of a stats row, 0 at least."""
    get = lambda k: F.coalesce(s[k].cast("int"), F.lit(0)) if k in s else F.lit(0)
    total = F.floor(get("saves") / 3)
    for name, weight in config.BPS_WEIGHTS.items():
        total += get(name) * weight
    return F.greatest(F.lit(0), total).cast("long")


def defensive_points(*actions: Column) -> Column:
    """D-9: half of the actions, five at most."""
    total = sum((F.coalesce(a, F.lit(0)) for a in actions[1:]), F.coalesce(actions[0], F.lit(0)))
    return F.least(F.lit(5), F.floor(total / 2)).cast("long")
