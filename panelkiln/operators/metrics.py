"""Which columns are metrics (P-13, P-28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import config

NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


def resolve_metrics(df: DataFrame, mean=None, sums=None, exclude=(), unlisted: bool = True) -> tuple[list[str], list[str]]:
    """(mean, sum) metrics of ``df`` from its schema alone: the listed ones that exist, and
    all other numeric columns as means, but for the fixed names that are no metrics and those of ``exclude``, such as
    the id columns of a source.  Sorted."""
    sums = set(config.SUM_METRICS if sums is None else sums)
    mean = set(config.MEAN_METRICS if mean is None else mean)
    out = config.NO_METRICS | set(exclude)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in out}
    found = (numeric & mean) | (numeric - sums if unlisted else set())
    return sorted(found - sums | (found & mean)), sorted(numeric & sums)


def feature_columns(df: DataFrame, target: str, exclude=()) -> list[str]:
    """Numeric columns that can be features of ``target``."""
    mean, sums = resolve_metrics(df, exclude={target, *exclude})
    return sorted({*mean, *sums})
