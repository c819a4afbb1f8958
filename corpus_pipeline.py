"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barframe.llm import mixing, neardup, packing, pii, quality
from barframe.llm.storage import discard, materialize, read_table, scratch

STAGES = [
    ("quality_rules", quality.quality_stage),
    ("near_dedup", neardup.near_dedup_stage),
    ("pii", pii.pii_stage),
    ("source_mix", mixing.mixing_stage),
    ("best_fit_packing", packing.packing_stage),
]

#: The stages hash, hold float models and search bins: SQL can't express them; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as kept:
            out = materialize(spark, stage(spark, docs, sf_dir), name)
            kept.append(out)
        if k:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
