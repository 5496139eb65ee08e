"""Results that several branches of a plan need, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """``df``, computed now: as a checkpoint in ``spark.checkpoint.dir``, or, where that is
    unset (tests, a single machine), in Spark's cache, which a lost executor rebuilds."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return df.checkpoint()
    return df.persist()
