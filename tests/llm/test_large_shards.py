"""Pairs that share one key only, that of a shard above the leaf."""

import numpy as np
from pyspark.sql import functions as F

from panelkiln.llm import simhash


def test_a_single_large_key_is_searched(spark):
    """nodes with one key of a large shard were left out of it."""
    n, draw = 24, np.random.default_rng(5)
    signs = [bytes(draw.integers(0, 256, simhash.N_SIGNS, dtype=np.uint8)) for _ in range(n)]
    sets = [np.unique(draw.integers(0, 2**62, 40).astype("<u8")).tobytes() for _ in range(n)]
    pairs = [(k, k + 12) for k in range(12)]
    for a, b in pairs:
        signs[b], sets[b] = signs[a], sets[a]
    keys = lambda k: [7, *[1000 + k * 10 + j for j in range(1, simhash.N_KEYS)]]  # noqa: E731  the first key is that of all
    reps = spark.createDataFrame([(k, keys(k), bytearray(signs[k])) for k in range(n)], "node long, keys array<long>, signs binary")
    held = spark.createDataFrame([(k, bytearray(signs[k]), bytearray(sets[k])) for k in range(n)], "node long, signs binary, set binary")
    found = simhash.similar_links(reps, lambda asked: held.join(asked, "node"), 0.8, leaf=4)
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in found.where(F.col("a") != F.col("b")).collect()}  # a node may meet itself, which joins nothing
    assert got == set(pairs)
