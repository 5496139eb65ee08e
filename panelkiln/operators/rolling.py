"""Rolling windows over an entity's rows (W-1 to W-4 and the documented ones D-1 to D-7).

All windows of one call share one partitioning and order, so one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


def _value(df: DataFrame, name: str) -> Column:
    """A metric with NaN as 0; null stays."""
    return F.nanvl(F.col(name), F.lit(0.0)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.col(name)


def _frames(keys, order, w: int):
    base = Window.partitionBy(*keys).orderBy(*order)
    return base, base.rowsBetween(-(w - 1), 0), base.rowsBetween(Window.unboundedPreceding, 0)


def rolling_mean(c: Column, keys, order, w: int) -> Column:
    """The mean of the last w rows if all are there and not null; else the running sum over
    the row number; null where the row's own value is."""
    base, last, all_ = _frames(keys, order, w)
    n = F.row_number().over(base)
    full = (n >= w) & (F.count(c).over(last) == w)
    return F.when(full, F.avg(c).over(last)).when(c.isNull(), F.lit(None)).otherwise(F.sum(c).over(all_) / n)


def rolling_sum(c: Column, keys, order, w: int) -> Column:
    base, last, all_ = _frames(keys, order, w)
    full = (F.row_number().over(base) >= w) & (F.count(c).over(last) == w)
    return F.when(full, F.sum(c).over(last)).when(c.isNull(), F.lit(None)).otherwise(F.sum(c).over(all_))


def full_mean(c: Column, keys, order, w: int) -> Column:
    """The mean of the last w rows, null until all are there and not null."""
    base, last, _ = _frames(keys, order, w)
    return F.when((F.row_number().over(base) >= w) & (F.count(c).over(last) == w), F.avg(c).over(last))


def rolling_features(df: DataFrame, keys=("player_id",), order=("season", "gameweek"), mean=(), sums=(), windows=config.WINDOWS) -> DataFrame:
    """W-1: ``df`` with {m}_rolling_mean_{w} and {m}_rolling_sum_{w}.  ``order`` should be
    total; without metrics the input comes back."""
    new = {f"{m}_rolling_mean_{w}": rolling_mean(_value(df, m), keys, order, w) for m in mean for w in windows}
    new |= {f"{m}_rolling_sum_{w}": rolling_sum(_value(df, m), keys, order, w) for m in sums for w in windows}
    return df.select("*", *[c.alias(n) for n, c in new.items()])


def team_rolling_features(df: DataFrame, keys=("team_id",), order=("season", "gameweek"), mean=(), sums=(), windows=config.WINDOWS, was_home="was_home") -> DataFrame:
    """W-2: W-1 by team, and the values shown only on home or only on away rows
    (computed over all of the team's rows)."""
    wide = rolling_features(df, keys, order, mean, sums, windows)
    names = [n for n in wide.columns if n not in df.columns]
    home = F.coalesce(F.col(was_home).cast("boolean"), F.lit(False))
    away = F.coalesce(~F.col(was_home).cast("boolean"), F.lit(False))
    return wide.select("*", *[F.when(home, F.col(n)).alias(f"home_{n}") for n in names], *[F.when(away, F.col(n)).alias(f"away_{n}") for n in names])


def form_metrics(df: DataFrame, keys=("player_id",), order=("season", "gameweek"), metrics=(), windows=None, prefix: str = "", decay: float | None = None) -> DataFrame:
    """W-3 and W-4: {prefix}{m}_form_{name} over the named numbers of rows, null until the
    window is full.  ``decay`` weighs a row by decay**age instead of the plain mean."""
    new = []
    for m in metrics:
        c = _value(df, m)
        for name, w in (windows or config.FORM_WINDOWS).items():
            if decay is None:
                value = full_mean(c, keys, order, w)
            else:
                base, last, _ = _frames(keys, order, w)
                rows = [F.lag(c, k).over(base) * decay**k for k in range(w)]
                value = F.when((F.row_number().over(base) >= w) & (F.count(c).over(last) == w), sum(rows[1:], rows[0]) / sum(decay**k for k in range(w)))
            new.append(value.alias(f"{prefix}{m}_form_{name}"))
    return df.select("*", *new)


# --- documented features


def minutes_reliability(df: DataFrame, keys, order, w: int, minutes: str = "minutes", starter_minutes: int = 60) -> DataFrame:
    """D-1: start probability, mean minutes when started, expected minutes, deviation."""
    _, last, _ = _frames(keys, order, w)
    m = F.col(minutes).cast("double")
    started = F.when(m >= starter_minutes, 1.0).otherwise(0.0)
    start = F.avg(started).over(last)
    when_started = F.try_divide(F.sum(F.when(m >= starter_minutes, m)).over(last), F.sum(started).over(last))
    return df.select("*", start.alias("start_prob"), when_started.alias("minutes_if_started"), (start * F.coalesce(when_started, F.lit(0.0))).alias("expected_minutes"), F.stddev_samp(m).over(last).alias("minutes_std"))


def per_90(df: DataFrame, keys, order, w: int, metrics, minutes: str = "minutes", least: int = 30) -> DataFrame:
    """D-2: {m}_per90_{w} over rows with at least ``least`` minutes."""
    _, last, _ = _frames(keys, order, w)
    used = F.col(minutes) >= least
    total = F.sum(F.when(used, F.col(minutes))).over(last)
    return df.select("*", *[(F.try_divide(F.sum(F.when(used, F.col(m))).over(last), total) * 90).alias(f"{m}_per90_{w}") for m in metrics])


def usage_share(df: DataFrame, keys, team_keys, order, w: int, metrics, period) -> DataFrame:
    """D-3: {m}_share_{w}, an entity's rolling sum over its team's in the same period.
    The team's periods are summed first, so a team row is one per period."""
    team = df.groupBy(*team_keys, *period).agg(*[F.sum(m).alias(f"_{m}") for m in metrics])
    _, team_last, _ = _frames(team_keys, period, w)
    team = team.select(*team_keys, *period, *[F.sum(f"_{m}").over(team_last).alias(f"_{m}") for m in metrics])
    _, last, _ = _frames(keys, order, w)
    mine = df.select("*", *[F.sum(m).over(last).alias(f"_own_{m}") for m in metrics])
    joined = mine.join(team, [*team_keys, *period], "left")
    return joined.select(*df.columns, *[F.try_divide(F.col(f"_own_{m}"), F.col(f"_{m}")).alias(f"{m}_share_{w}") for m in metrics])


def ratios(df: DataFrame, keys, order, w: int, pairs: dict) -> DataFrame:
    """D-4: named ratios of rolling sums, null where the lower sum is 0."""
    _, last, _ = _frames(keys, order, w)
    return df.select("*", *[F.try_divide(F.sum(F.col(a).cast("double")).over(last), F.sum(F.col(b).cast("double")).over(last)).alias(name) for name, (a, b) in pairs.items()])


def team_strength_window(df: DataFrame, keys, order, w: int, scored: str, conceded: str) -> DataFrame:
    """D-5: rolling means and deviations of what a team scores and concedes."""
    _, last, _ = _frames(keys, order, w)
    return df.select("*", *[f(c).over(last).alias(f"{c}_{n}_{w}") for c in (scored, conceded) for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def form_ratio(df: DataFrame, keys, order, metric: str, short: int = 3, long: int = 10) -> DataFrame:
    """D-7: mean of the last ``short`` over the last ``long`` rows, and to date."""
    _, a, _ = _frames(keys, order, short)
    _, b, to_date = _frames(keys, order, long)
    return df.select("*", F.try_divide(F.avg(metric).over(a), F.avg(metric).over(b)).alias(f"{metric}_form_ratio"), F.avg(metric).over(to_date).alias(f"{metric}_to_date"))


def form_index(df: DataFrame, keys, order, metric: str, weights=(5, 4, 3, 2, 1)) -> DataFrame:
    """D-11: weighted mean of the last rows (newest first), and the deviation of the last ten."""
    base, _, _ = _frames(keys, order, 1)
    _, ten, _ = _frames(keys, order, 10)
    values = [F.lag(metric, k).over(base) for k in range(len(weights))]
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values[1:], weights[1:])), F.coalesce(values[0] * weights[0], F.lit(0.0)))
    low = sum((F.when(v.isNotNull(), w).otherwise(0) for v, w in zip(values[1:], weights[1:])), F.when(values[0].isNotNull(), weights[0]).otherwise(0))
    return df.select("*", F.try_divide(top, low).alias(f"{metric}_form_index"), F.stddev_samp(metric).over(ten).alias(f"{metric}_consistency"))


def forward_means(df: DataFrame, keys, order, metric: str, spans=(1, 3, 5)) -> DataFrame:
    """D-11: means of the next rows, such as coming fixtures' difficulty."""
    base = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[F.avg(metric).over(base.rowsBetween(1, n)).alias(f"{metric}_next_{n}") for n in spans])
