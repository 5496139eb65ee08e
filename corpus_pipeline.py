"""Corpus pipeline: language ID, quality, near-dedup, substring dedup, packing."""

from __future__ import annotations

from panelkiln.llm import stages
from panelkiln.llm.shared import written

STAGES = [
    ("language", stages.language),
    ("quality", stages.quality_filter),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("packing", stages.packed),
]

ORACLE_SQL = None  # classifiers and fingerprints are beyond SQL; tests hold the stages against brute force


def run(spark, sf_dir):
    """The packed rows of ``documents`` after every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
