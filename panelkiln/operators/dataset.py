"""Training sets, shots and correlations (W-12 to W-14, A-24 to A-27, D-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_period_target(df: DataFrame, key, order, metric: str = "total_points", into: str = "next_gw_points", drop=(), features: DataFrame | None = None, on=()) -> DataFrame:
    """W-12: the metric's next value as target; rows without one go."""
    d = df.withColumn(into, F.lead(metric).over(Window.partitionBy(*key).orderBy(*order))).where(F.col(into).isNotNull()).drop(*drop)
    return d.join(features, list(on), "left") if features is not None else d


def starter_dataset(df: DataFrame, minutes: str = "minutes", least: int = 60, features: DataFrame | None = None, on=()) -> DataFrame:
    """W-13: is_starter, without the column it leaks from."""
    d = df.withColumn("is_starter", F.when(F.col(minutes) >= least, 1).otherwise(0)).drop(minutes)
    return d.join(features, list(on), "left") if features is not None else d


def time_split(df: DataFrame, period: str = "gameweek", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """W-14: ``split`` by the rank of distinct periods (a small table, ranked once)."""
    if period not in df.columns:
        raise ValueError(f"no column {period}")
    periods = df.select(period).where(F.col(period).isNotNull()).distinct()
    ranked = periods.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(period))).crossJoin(F.broadcast(periods.agg(F.count("*").alias("_n"))))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.ceil(F.col("_n") * validation)
    label = F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "validation").otherwise("test")
    return df.join(ranked.select(period, label.alias("split")), period, "left")


def walk_forward(df: DataFrame, folds: DataFrame, period: str = "gameweek") -> DataFrame:
    """D-10: for each fold (fold, at) its rows before ``at`` as train and at it as test.
    Folds meet distinct periods; rows join those by their period, where they lie: a period in a
    fold is a row of a small table, and all rows of a period would else be one task."""
    roles = df.select(F.col(period).alias("_p")).distinct().join(folds, F.col("_p") <= F.col("at"))
    roles = roles.withColumn("role", F.when(F.col("_p") < F.col("at"), "train").otherwise("test")).drop("at")
    return df.join(F.broadcast(roles), F.col(period) == F.col("_p")).drop("_p")


def expanding_folds(df: DataFrame, period: str = "gameweek", number: int = 3, gap: int = 0) -> DataFrame:
    """D-10: (fold, at, until): the last ``number`` distinct periods as tests, each after a
    training set of all periods up to ``until``, ``gap`` periods before it.  A period without
    one to learn from is no fold.  Distinct periods are a small table, as in W-14."""
    if number < 1 or gap < 0:
        raise ValueError("at least one fold, and no negative gap")
    all_ = Window.partitionBy(F.lit(1))
    periods = df.select(F.col(period).alias("at")).where(F.col("at").isNotNull()).distinct()
    placed = periods.withColumns({"_k": F.row_number().over(all_.orderBy("at")), "until": F.lag("at", gap + 1).over(all_.orderBy("at")), "_n": F.count("*").over(all_)})
    folds = placed.where((F.col("_k") > F.col("_n") - number) & F.col("until").isNotNull())
    return folds.select((F.col("_k") - F.col("_n") + number).cast("int").alias("fold"), "at", "until")


# Set pieces, and the one location outside the box.
SET_PIECES = ("FromCorner", "SetPiece", "DirectFreekick")
OUTSIDE = "Outside box"


def shot_features(shots: DataFrame, by=("player_id", "gameweek"), ids: DataFrame | None = None, outside: str = OUTSIDE, penalty: str = "Penalty", set_pieces=SET_PIECES) -> DataFrame:
    """A-24; ``ids`` (player_id, mapped_id) maps players and drops the others."""
    if ids is not None:
        shots = shots.join(ids, "player_id").drop("player_id").withColumnRenamed("mapped_id", "player_id")
    return shots.groupBy(*by).agg(
        F.avg("xg").alias("avg_shot_xg"), F.count("*").alias("shot_frequency"), F.avg(F.col("goal").cast("double")).alias("conversion_rate"),
        F.avg((F.col("location") != outside).cast("double")).alias("box_entry_rate"), F.max((F.col("situation") == penalty).cast("int")).alias("penalty_involvement"),
        F.max(F.col("situation").isin(*set_pieces).cast("int")).alias("set_piece_taking"), F.count_distinct("body_part").alias("body_part_diversity"),
    )


def class_weights(df: DataFrame, target: str = "is_starter") -> DataFrame:
    """A-25: scale_pos_weight = zeros / ones; empty without the target."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "scale_pos_weight double")
    return df.agg(F.try_divide(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).alias("scale_pos_weight"))


def _products(columns: list[str], shift: list[float]):
    """A task's sums of products of all pairs of columns, as one row for each column: values
    less ``shift``, null as absent, NaN and infinities counted apart."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        k, total = len(columns), None
        for batch in batches:
            arrays = [batch.column(c) for c in range(k)]
            there = np.column_stack([np.ones(batch.num_rows) if not a.null_count else np.asarray(a.is_valid()).astype(float) for a in arrays]) if k else np.zeros((batch.num_rows, 0))
            x = np.column_stack([a.fill_null(0.0).to_numpy(zero_copy_only=False) for a in arrays])
            odd = (~np.isfinite(x)).astype(float) * there
            x = np.where((there > 0) & (odd == 0), np.where(np.isfinite(x), x, 0.0) - np.array(shift), 0.0)
            new = np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x, odd.T @ there + there.T @ odd])
            total = new if total is None else total + new
        if total is not None:
            flat = [pa.array(np.asarray(m).ravel()) for m in total]
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *flat], ["i", "j", "n", "x", "xx", "xy", "odd"])

    return sums


def correlations(df: DataFrame, columns, threshold: float = 0.95) -> DataFrame:
    """A-26: pairs of columns (the earlier first) with a high absolute correlation over the
    rows where both have a value, as Spark's ``corr``: NaN where a value of a pair is NaN or
    infinite, no row without variance.

    One pass makes the products of all columns at once in each task (a matrix of the number
    of columns squared, whatever the rows), and Spark sums those by pair; so many columns
    need no expression for each pair.  Values are taken less the column's mean."""
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    d = df.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    shift = [float(v or 0.0) for v in d.agg(*[F.avg(finite(c)) for c in d.columns]).first()]
    parts = d.mapInArrow(_products(columns, shift), "i long, j long, n double, x double, xx double, xy double, odd double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy", "odd")])
    names = F.array(*[F.lit(c) for c in columns])
    other = sums.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    pairs = sums.where("i < j").join(other, ["i", "j"])
    spread = lambda s, q, m: F.greatest(q - s * s / F.col("n"), F.lit(0.0)) > F.col("n") * m * m * 1e-24  # noqa: E731  below it: a constant, rounded
    means = F.array(*[F.lit(v) for v in shift])
    mean = lambda k: F.element_at(means, (F.col(k) + 1).cast("int"))
    root = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n")))
    found = F.when(F.col("odd") > 0, F.lit(float("nan"))).when((F.col("n") > 1) & spread(F.col("x"), F.col("xx"), mean("i")) & spread(F.col("y"), F.col("yy"), mean("j")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / root)))
    name = lambda k: F.element_at(names, (F.col(k) + 1).cast("int"))
    return pairs.select(name("i").alias("feature_a"), name("j").alias("feature_b"), found.alias("correlation")).where(F.abs("correlation") >= threshold)


def importance_baseline(df: DataFrame, columns, target: str) -> DataFrame:
    """A-27: features by absolute correlation with the target; empty without it."""
    if target not in df.columns or not columns:
        return df.sparkSession.createDataFrame([], "feature string, correlation double")
    rows = [F.struct(F.lit(c).alias("feature"), F.corr(c, target).alias("correlation")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).where(F.col("correlation").isNotNull())
