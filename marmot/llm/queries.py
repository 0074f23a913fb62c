"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marmot.llm.common import table
from marmot.session import scratch_path


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.decontaminate import contamination, summarise
    return summarise(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.tokenfile import read_token_files, write_token_files
    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"),
                                 tokenizer_path("word_bpe_49k.json"), lower=True, end=1)
    return read_token_files(manifest)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.packing import pack, pieces
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), lower=False, end=0))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.quality import fit, learnable, scored
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op2_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.search import top_k
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 50 = 0"), k=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.linededup import line_deduplicated
    return line_deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.quality import learnable
    from marmot.llm.toxicity import fit, scored
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.pii import find, fit
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.html import extract
    return extract(table(spark, sf_dir, "pages"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.chat import digests, examples
    said = F.lit(r"\### Assistant: </turn> ok")
    two = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(two)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.alignment import alignment
    return alignment(table(spark, sf_dir, "documents"), scratch_path(spark, "alignment"),
                     tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marmot.llm.structure import summary
    return summary(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_search": op2_exact_search,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_token_output": op8_token_output,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_token_alignment": op12_token_alignment,
    "op13_structure_repair": op13_structure_repair,
}
