"""Readers, writers, upserts and season overwrites (SRC-1 to SRC-18)."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.lineage import once

SEASON = re.compile(r"\A\d{4}-\d{2}\Z")


def read_documents(spark: SparkSession, path: str, schema: str, array: str | None = None, multi_line: bool = True) -> DataFrame:
    """SRC-1, SRC-2: JSON documents; with ``array`` the rows of that array of structs.  An
    absent or empty array gives the typed columns and no rows.  ``multi_line``: a file is
    one document; else each of its lines is."""
    d = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return d.select(F.explode(array).alias("_e")).select("_e.*") if array else d


def read_histories(spark: SparkSession, path: str, schema: str, array: str = "history", id_pattern: str = r"(\d+)\.json$", id_col: str = "player_id", multi_line: bool = True) -> DataFrame:
    """SRC-3: one document per entity; rows of its array with the id in the file name."""
    d = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    rows = d.select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).cast("long").alias(id_col), F.explode(array).alias("_e"))
    return rows.select(id_col, "_e.*")


def read_csv_table(spark: SparkSession, path: str, schema: str | None = None, nulls=("None",), where=None, types: dict | None = None) -> DataFrame:
    """SRC-4, SRC-5, SRC-9: CSV with a header; "" and ``nulls`` are null, bad values of
    ``types`` are null, an optional row filter."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "")
    d = (reader.schema(schema) if schema else reader).csv(path)
    strings = [f.name for f in d.schema if f.dataType.simpleString() == "string"]
    d = d.withColumns({c: F.when(~F.col(c).isin(*nulls), F.col(c)) for c in strings}) if strings and nulls else d
    d = d.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items() if c in d.columns}) if types else d
    return d.where(where) if where is not None else d


def read_variations(spark: SparkSession, path: str, source: str = "source", canonical: str = "canonical") -> DataFrame:
    """P-15: known variations (source, canonical) of a CSV file with a header, whatever its
    other columns."""
    d = spark.read.option("header", True).option("nullValue", "").csv(path)
    return d.select(F.col(source).cast("string").alias("source"), F.col(canonical).cast("string").alias("canonical"))


def read_seasons(paths: dict[str, DataFrame]) -> DataFrame:
    """SRC-6: frames tagged with their season, columns united."""
    return merge.diagonal(*[d.withColumn("season", F.lit(s)) for s, d in paths.items()])


def read_table(spark: SparkSession, path: str, columns=None, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, order=()) -> DataFrame:
    """SRC-7, SRC-8, SRC-10: projection, filters and order over a Parquet table; columns
    and filters reach the scan."""
    d = spark.read.parquet(path)
    preds = [F.col(c) == v for c, v in (equal or {}).items()] + [F.col(c) >= v for c, v in (at_least or {}).items()] + [F.col(c) <= v for c, v in (at_most or {}).items()]
    d = reduce(DataFrame.where, preds, d)
    d = d.select(*columns) if columns else d
    return d.orderBy(*order) if order else d


def read_season_table(spark: SparkSession, path: str, seasons=None, season: str = "season") -> DataFrame:
    """SRC-11: a table partitioned by season; only the named partitions are read."""
    d = spark.read.parquet(path)
    return d.where(F.col(season).isin(list(seasons))) if seasons is not None else d


def count_rows(df: DataFrame, where=None) -> int:
    """SRC-12."""
    return (df.where(where) if where is not None else df).count()


def counted(df: DataFrame, where=None, into: str = "n") -> DataFrame:
    """SRC-12 as a lazy table of one row; an empty table has 0."""
    return (df.where(where) if where is not None else df).agg(F.count("*").alias(into))


def upsert(existing: DataFrame, new: DataFrame, keys, score: str | None = None, sequence=(), skip_existing: bool = False) -> DataFrame:
    """SRC-13: the table after an upsert by business key: new rows deduplicated (W-8), then
    either replacing rows with their key or, with ``skip_existing``, only added."""
    return _merged(existing, merge.keep_best(new, keys, score, sequence), keys, skip_existing)


def _merged(existing: DataFrame, fresh: DataFrame, keys, skip_existing: bool) -> DataFrame:
    if skip_existing:
        return existing.unionByName(merge.new_keys(fresh, existing, keys), allowMissingColumns=True)
    return merge.new_keys(existing, fresh, keys).unionByName(fresh, allowMissingColumns=True)


BUCKET = re.compile(r"\Abucket_of_(\d+)\Z")


def _bucketed(df: DataFrame, keys, number: int) -> DataFrame:
    """``df`` with the bucket of its key, a hash of the keys as text."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return df.withColumn(f"bucket_of_{number}", F.pmod(F.xxhash64(*texts), F.lit(number)).cast("int"))


def create_keyed(df: DataFrame, path: str, keys, number: int = 64) -> None:
    """SRC-13: a table in ``number`` partitions by a hash of its key, which ``upsert_keyed``
    changes in place.  Rows as they are; choose the number so that a partition fits a task."""
    if any(BUCKET.match(c) for c in df.columns):
        raise ValueError("a column named like the bucket")
    _bucketed(df, keys, number).repartition(f"bucket_of_{number}").write.partitionBy(f"bucket_of_{number}").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path)
    return d.drop(*[c for c in d.columns if BUCKET.match(c)])


def upsert_keyed(new: DataFrame, path: str, keys, score: str | None = None, sequence=(), skip_existing: bool = False) -> list[int]:
    """SRC-13: ``upsert`` into a table of ``create_keyed`` that reads and writes only the
    partitions to which keys of ``new`` belong; returns them.  Files of the others stay as they
    are.  Keys are compared in the table's types, so give new ones that these can hold.  Rows
    of a null key go; without ``score`` and ``sequence`` the last row of a key by its other
    columns stays.  Columns that the table lacks are an error.  The new partitions take the
    place of the old ones when the job commits; who reads at that moment should read a
    version (``write_version``)."""
    spark = new.sparkSession
    table = spark.read.parquet(path)
    name = next(c for c in table.columns if BUCKET.match(c))
    columns = [c for c in table.columns if c != name]
    extra = set(new.columns) - {*columns, *sequence} - ({score} if score else set())
    if extra:
        raise ValueError(f"columns that the table lacks: {sorted(extra)}")
    typed = new.withColumns({k: F.col(k).cast(table.schema[k].dataType) for k in keys})
    sequence = sequence or ([] if score else [c for c in new.columns if c not in keys])
    fresh = once(_bucketed(merge.keep_best(typed, keys, score, sequence), keys, int(BUCKET.match(name)[1])))
    touched = sorted(r[0] for r in fresh.select(name).distinct().collect())  # at most one a partition of the table
    if not touched:
        return []
    old, fresh = table.where(F.col(name).isin(touched)), fresh.select(*[c for c in fresh.columns if c in table.columns])
    merged = _merged(old, fresh, keys, skip_existing)
    out = merged.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in [*columns, name]])
    out.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return touched


def write_version(df: DataFrame, root: str, partition_by=()) -> str:
    """SRC-13, SRC-15: write a new version folder and return it; the caller points readers
    to it, so a table is never overwritten while it is read."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def append(df: DataFrame, path: str, partition_by=()) -> None:
    """SRC-14."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace_season(df: DataFrame, path: str, season: str, column: str = "season") -> bool:
    """SRC-16: replace one season's partition only.  A malformed season is an error; an
    empty frame replaces nothing and gives False.  Rows of other seasons are an error."""
    if not isinstance(season, str) or not SEASON.match(season):
        raise ValueError(f"not a season: {season!r}")
    facts = df.agg(F.count("*").alias("n"), F.count_if(~F.col(column).eqNullSafe(season)).alias("other")).first()
    if facts["other"]:
        raise ValueError("rows of another season")
    if not facts["n"]:
        return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return True


def append_mappings(existing: DataFrame, new: DataFrame, keys, only_new: bool = True) -> DataFrame:
    """SRC-17."""
    return existing.unionByName(merge.new_keys(new, existing, keys) if only_new else new, allowMissingColumns=True)


def without_managed(df: DataFrame, managed=("id", "created_at", "updated_at")) -> DataFrame:
    """SRC-18: without the columns that the server keeps."""
    return df.drop(*managed)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
