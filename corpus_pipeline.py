"""Corpus preparation: quality filter, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marmot.llm import stages as S
from marmot.llm.common import saved, table

STAGES = [
    ("quality", S.quality),
    ("line_dedup", S.line_dedup),
    ("near_dedup", S.near_dedup),
    ("decontamination", S.decontamination),
    ("packing", S.packing),
]

#: Training a classifier and a genetic algorithm are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
