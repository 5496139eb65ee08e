"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir).

All but the last return the columns of ``docs``, whatever they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import langid, packing, quality, recompression, simhash
from .components import with_least
from .shared import passing, unused, written

MIN_LANGUAGE_SCORE = 0.4


def language(spark, docs, sf_dir):
    """Rejects documents without a letter, and those whose best language has a score
    below ``MIN_LANGUAGE_SCORE`` (no language fits, or several as well as each other)."""
    model = langid.train(docs)
    named = langid.identify(docs, model, prefix="_lang_")
    good = (F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)
    return named.where(good).select(*docs.columns)


def quality_filter(spark, docs, sf_dir):
    """Rejects documents that the classifier does not accept; each row is judged by its own
    text, where it lies."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    score = unused(docs, "_score")
    return quality.score(docs, model, into=score).where(F.col(score) >= quality.ACCEPT).select(*docs.columns)


def _row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, that with the least id (null
    ids come last, rows of one id are apart): five words, a similarity of 0.8.  Of rows that
    are equal in all columns one stays.

    Keys of what goes and of equal rows are a table, which Spark broadcasts if it is small;
    then texts stay where they are, but for those of equal rows."""
    # maps have no hash of their own, so columns that hold one are hashed as text
    every = [F.struct(F.col(c).isNull(), F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c)) for c in docs.columns if c not in ("doc_id", "text")]
    key, gone = unused(docs, "_key"), unused(docs, "_gone")
    keyed = docs.withColumn(key, F.xxhash64(_row_key(), *every))
    with passing(spark):
        found = simhash.near_duplicates(keyed, id_col=key, shingle=5, similarity=0.8)
        groups = written(found.groupBy(F.col("row_id").alias("key"), "component_id").agg(F.count("*").alias("n")), "groups")
        places = keyed.select(F.col(key).alias("key"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key")).alias("place")).distinct()
        least = with_least(groups.join(places, "key"), "component_id", "place", "key", "kept")
        other = F.col("key") != F.col("kept.key")
        marked = written(least.where(other | (F.col("n") > 1)).select(F.col("key").alias(key), other.alias(gone)), "marked", keep=True)
    judged = keyed.join(marked, key, "left")
    return judged.where(F.col(gone).isNull()).unionByName(judged.where(~F.col(gone)).dropDuplicates([key])).select(*docs.columns)


def substring_dedup(spark, docs, sf_dir):
    """Repeated passages are cut out of the texts; texts without one stay as they are, and
    documents of which nothing is left go."""
    cut = recompression.dedup_substrings(docs, carry=docs.columns, result="text")
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    kept = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def packed(spark, docs, sf_dir):
    """The bins of what is left; no bin holds a source twice."""
    return packing.pack(docs).withColumnRenamed("row_id", "doc_id")
