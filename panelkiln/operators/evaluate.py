"""Evaluation of predictions (A-28 to A-33, D-12, M-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cell, cuts, exact_quantiles


def regression_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    """A-28: rmse, mae, r2, mape (rows with truth 0 left out), n."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    e = t - p
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(t))).alias("r2"),
        (F.avg(F.when(t != 0, F.abs(e / F.when(t != 0, t)))) * 100).alias("mape"), F.count("*").alias("n"),
    )


def residuals(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A-29, the column."""
    return df.withColumn("residual", F.col(truth) - F.col(pred))


def residual_summary(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    r = F.col(truth) - F.col(pred)
    return df.agg(F.avg(r).alias("bias"), F.stddev_samp(r).alias("residual_std"), F.min(r).alias("residual_min"), F.max(r).alias("residual_max"))


def error_by(df: DataFrame, category: str, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A-30."""
    return df.groupBy(category).agg(F.avg(F.abs(F.col(truth) - F.col(pred))).alias("mae"), F.count("*").alias("n"))


def baseline_comparison(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A-31: mae of the model and of constant mean and median, and the gains in percent."""
    middle = exact_quantiles(df, truth, [0.5], into="_m").select(F.col("_m")[0].alias("_median"))
    d = df.crossJoin(F.broadcast(df.agg(F.avg(truth).alias("_mean")))).crossJoin(F.broadcast(middle))  # one row each
    mae = lambda c: F.avg(F.abs(F.col(truth) - F.col(c)))
    g = d.agg(mae(pred).alias("model_mae"), mae("_mean").alias("mean_mae"), mae("_median").alias("median_mae"))
    gain = lambda c: F.try_divide(F.col(c) - F.col("model_mae"), F.col(c)) * 100
    return g.select("*", gain("mean_mae").alias("gain_over_mean"), gain("median_mae").alias("gain_over_median"))


def classification_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A-32 without the AUC: counts of the confusion matrix and rates, 0 where undefined."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    g = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("*", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, truth: str = "y_true", score: str = "y_proba") -> DataFrame:
    """A-32: Mann-Whitney from counts by distinct score.

    The counts get their ranks from one running sum over distinct scores; ranges of scores
    (at quantiles) are summed first, so no task sees them all.  Rows without a score do
    not count."""
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")).where("s is not null")
    ranged = per.withColumn("b", cell(F.col("s"), cuts(df, score)))
    sums = ranged.groupBy("b").agg(F.sum("neg").alias("n"))
    before = sums.select("b", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranged.withColumn("_i", inner).join(F.broadcast(before), "b").agg(F.sum(F.col("pos") * (F.col("before") + F.col("_i") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return won.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("roc_auc"))


def distribution_summary(df: DataFrame, key, value: str, boom: float) -> DataFrame:
    """A-33: per entity mean, median, quantiles, deviation and the rate at or above ``boom``."""
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    g = df.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) >= boom).cast("double")).alias("boom_rate"))
    found = exact_quantiles(df, value, q, key, "_p").select(*[F.col(c).alias(f"_g_{k}") for k, c in enumerate(key)], "_p")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{k}")) for k, c in enumerate(key)])
    return g.join(found, same, "left").select(*key, "mean", *[F.col("_p")[k].alias(n) for k, n in enumerate(("p10", "p25", "median", "p75", "p90"))], "std", "boom_rate")


def pinball_loss(df: DataFrame, truth: str, quantiles: dict[float, str]) -> DataFrame:
    """D-12: mean pinball loss of each quantile column."""
    out = []
    for q, c in quantiles.items():
        e = F.col(truth) - F.col(c)
        out.append(F.avg(F.greatest(e * q, e * (q - 1))).alias(f"pinball_{int(q * 100)}"))
    return df.agg(*out)


def log_loss(df: DataFrame, truth: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """D-12."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(prob)))
    return df.agg(F.avg(-F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
