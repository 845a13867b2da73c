"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaptura.llm import bpe, centroids, decontamination, fill_middle, html_text, licenses, neighbours, pii, quality, simhash, sstable, suffix_dedup, token_counts
from kaptura.llm.common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_id_table(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.restored(fill_middle.transform(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_bpe, op3_quality_rules, op4_license_scan, op5_decontamination, op6_token_ids, op7_html_text, op8_token_counts, op9_private_data, op10_suffix_dedup, op11_nearest, op12_fill_middle, op13_centroids)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.ORACLE, "op5_decontamination": decontamination.ORACLE, "op12_fill_middle": fill_middle.ORACLE, "op13_centroids": centroids.ORACLE}
