"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from junctura.llm import common, decontamination, divergence, html_text, manifest, mixing, oracles, packing, quality_model, quality_rules, simhash, substring_dedup, topk, url_filter, warc

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(spark, _documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_documents(spark, sf_dir))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "features.n_words", "features.word_chars", "features.n_symbols", "features.n_dup_lines",
        "features.n_repeat_words", "features.n_lines", "features.n_stop_words", "base_failed", "kept", "failed_rule",
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality_model.score(spark, docs, model)
    return found.withColumn("predicted", (F.col("score") >= quality_model.THRESHOLD).cast("int"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(spark, _documents(spark, sf_dir))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.whole_units(F.col("embedding")).alias("v"))
    return topk.top_k(spark, vectors, vectors.where("vec_id % 50 = 0"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judged(spark, pages, url_filter.rules(spark, URL_RULES))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages, audited against a replica in which two pages of 211 are damaged by rule.

    The replica's records are made of its own pages and hashed whole; a lost one leaves a hole.
    """
    tables = common.Tables(spark, "op9")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    primary = tables.put("primary", warc.archive(pages, tables))
    altered = F.concat(F.lit("~"), F.coalesce(F.substring("html", 2, 1 << 30), F.lit("")))
    damaged = pages.select("page_id", "url", F.when(F.col("page_id") % 211 == 7, altered).otherwise(F.col("html")).alias("html"), warc.identity(F.col("url"), F.col("html")).alias("record_id"))
    replica = warc.archive(damaged, tables, "replica-records", F.col("record_id")).where("page_id is null or page_id % 211 <> 11")
    return warc.checked(spark, primary, tables.put("replica", replica))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _documents(spark, sf_dir), tokenizer_path(TOKENIZER))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(spark, _documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, against which those with one number more in n_chars by rule are checked."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.audited(spark, _documents(spark, sf_dir), {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash": op6_simhash,
    "op7_kd_tree_top_k": op7_kd_tree_top_k,
    "op8_url_filter": op8_url_filter,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": oracles.op2(list(dict.fromkeys(quality_rules.STOP_WORDS))),
    "op4_substring_dedup": oracles.OP4,
    "op7_kd_tree_top_k": oracles.OP7,
    "op8_url_filter": oracles.op8(URL_RULES),
    "op9_warc_fixity": oracles.OP9,
    "op11_source_divergence": oracles.OP11,
    "op12_decontamination": oracles.OP12,
    "op13_merkle_manifest": oracles.OP13,
}
