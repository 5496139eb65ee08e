"""A common passage makes no large shard of texts that are not alike."""

from pyspark.sql import functions as F

from panelkiln.llm import simhash


def _texts(n):
    line = " ".join(f"common{k}" for k in range(24))
    return [(k, line + " " + " ".join(f"own{k}x{j}" for j in range(80))) for k in range(n)]


def test_a_common_passage_makes_no_large_shard(spark):
    """Pipeline of round 3: with one hash a key these texts met in many pairs, which grow with the square."""
    docs = spark.createDataFrame(_texts(400), "doc_id long, text string")
    nodes = simhash.fingerprints(docs, shingle=5, signs=True).select("node", "keys")
    assert simhash._shards(nodes).agg(F.coalesce(F.sum(F.col("n") - 1) / 2, F.lit(0))).first()[0] <= 1000  # of 79,800 pairs


def test_bands_lose_no_more_than_eight_hashes_did():
    for percent in range(80, 101):
        like = percent / 100
        assert (1 - like**simhash.BAND) ** simhash.N_KEYS <= (1 - like) ** 8 * (1 + 1e-9) or percent == 100
    assert simhash.BAND * simhash.N_KEYS <= simhash.N_SIGNS


def test_near_copies_with_a_common_passage_are_joined(spark):
    """Each text and a copy with one more word; groups with whole shards in blocks and without."""
    rows = [x for k, text in _texts(60) for x in ((2 * k, text), (2 * k + 1, text + " more"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for leaf in (4, 512):
        got = {r.row_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8, leaf=leaf).collect()}
        assert got == {i: i - i % 2 for i, _ in rows}
