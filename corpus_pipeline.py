"""From documents to packed sequences: each stage's rows are written and read again by the next.

The stages take the operators' production parameters; near-duplicates are documents whose five-word shingles have a
Jaccard index of 0.8 or more, found by SimHash blocks (op6's three words and two bits bind only its own query).
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from junctura.llm import common, mixing, near_copies, packing, quality_rules, substring_dedup

TOKENIZER = "word_bpe_49k.json"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return near_copies.one_of_each(spark, docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document with a smaller doc_id has."""
    return substring_dedup.without_repeats(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them, shuffled by shard."""
    return mixing.mixture(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix with their place in a packed sequence."""
    return packing.pack_documents(spark, docs, tokenizer_path(TOKENIZER))


STAGES = [("quality rules", rules), ("SimHash near-dedup", near_dedup), ("substring dedup", span_dedup), ("mixing", mix), ("best-fit packing", pack)]
#: SQL has no tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = common.Tables(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = tables.put(f"stage{at}", docs)
    return docs
