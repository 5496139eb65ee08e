"""Projections and rankings (W-15, T-2 to T-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cell, cuts

DIFFERENTIAL_OWNERSHIP, CAPTAIN_START = 10.0, 0.5  # parameters; tests of the source leave a range


def scores(df: DataFrame, points: str = "mean_points", prob: str = "xi_prob", ownership: str = "ownership", differential: float = DIFFERENTIAL_OWNERSHIP) -> DataFrame:
    """combined_score and is_differential: all that T-2 and T-3 need of W-15."""
    return df.withColumns({"combined_score": F.col(points) * F.col(prob), "is_differential": F.col(ownership) < differential})


def projections(df: DataFrame, by=(), player: str = "player_id", points: str = "mean_points", prob: str = "xi_prob", ownership: str = "ownership", position: str = "position", differential: float = DIFFERENTIAL_OWNERSHIP) -> DataFrame:
    """W-15: combined_score, overall_rank (within ``by``, such as the gameweek),
    position_rank and is_differential.  Ties go to the smaller id."""
    d = scores(df, points, prob, ownership, differential)
    order = [F.col("combined_score").desc_nulls_last(), F.col(player)]
    return ranks(ranks(d, list(by), order, "combined_score", "overall_rank"), [*by, position], order, "combined_score", "position_rank")


def ranks(df: DataFrame, by: list, order: list, score: str, into: str) -> DataFrame:
    """The row number within ``by`` in ``order``, which begins with ``score`` descending.
    The rows are cut into ranges of the score at quantiles, a number for each shuffle
    partition; a row's number is that within its range and the rows of the ranges above, so
    no task holds all rows of a group.  Null scores come last."""
    at = cuts(df, score)
    dealt = df.withColumn("_range", F.when(F.col(score).isNull(), len(at) + 1).otherwise(len(at) - cell(F.col(score), at)))
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = sizes.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), (F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)]])
    within = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    return within.join(before, same).withColumn(into, (F.col("_k") + F.col("_before")).cast("int")).select(*df.columns, into)


def captains(df: DataFrame, n: int = 5, prob: str = "xi_prob", least: float = CAPTAIN_START, ownership: str = "ownership", player: str = "player_id") -> DataFrame:
    """T-2: the best by combined score among likely starters, with reasons."""
    reason = F.concat_ws("; ", F.lit("high projection"), F.when(F.col(prob) >= 0.9, "nailed on"), F.when(F.col(ownership) < DIFFERENTIAL_OWNERSHIP, "differential"))
    return df.where(F.col(prob) >= least).withColumn("reason", reason).orderBy(F.desc_nulls_last("combined_score"), player).limit(n)


def differentials(df: DataFrame, n: int = 10, player: str = "player_id") -> DataFrame:
    """T-3."""
    return df.where("is_differential").orderBy(F.desc_nulls_last("combined_score"), player).limit(n)


def predictions_for(predictions: DataFrame, players: DataFrame, period: str, value, player: str = "player_id", score: str = "predicted_points") -> DataFrame:
    """T-4: a period's predictions with their players, best first."""
    return predictions.where(F.col(period) == value).join(players, player).orderBy(F.desc_nulls_last(score), player)
