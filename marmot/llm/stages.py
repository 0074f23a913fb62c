"""The stages of the corpus pipeline: each takes the predecessor's documents and applies one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marmot.llm.common import table
from marmot.llm.queries import tokenizer_path


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the smallest id's.

    Repeated rows of the kept id are one document and leave one row; rows without an id stay.
    """
    from marmot.llm.minhash import near_duplicates
    kept = near_duplicates(docs, k=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    return (docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where("doc_id is null")).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    from marmot.llm.decontaminate import clean_documents
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    from marmot.llm.packing import pack, pieces
    return pack(pieces(docs, tokenizer_path("byte_bpe_50k.json"), lower=False, end=0))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    from marmot.llm.quality import fit, scored
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col("_predicted") == 1).drop("_score", "_predicted")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document of which nothing is left goes."""
    from marmot.llm.linededup import deduplicated
    return deduplicated(docs)
