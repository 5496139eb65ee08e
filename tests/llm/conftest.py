import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A table with null, empty, long, tied and repeated rows, and extra columns whose
    names clash with those the operators use."""
    text = "The quick brown fox jumps over the lazy dog near the river bank today. "
    rows = [
        (1, text * 3, "en", "a"), (2, text * 3, "en", "a"), (2, text * 3, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "   \n\t ", "fr", "b"), (None, text, "en", "a"),
        (6, "a", "fr", "c"), (7, " ".join(f"w{k}" for k in range(30000)), "en", "c"), (8, "x" * 50000, None, "c"), (9, "12345 !!! ###", "de", None), (10, "le renard brun saute par dessus le chien paresseux. " * 4, "fr", "d"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    clash = ["shard", "key", "n", "node", "row_id", "fp", "score", "bucket", "word", "ids", "carry", "kept", "hashes", "keys", "cluster"]
    return d.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(7).alias(c) for c in clash])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
