"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import classifier, decontam, licenses, linefreq, mixing, pagediff, sharding, simhash, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_char, end_char, n_words of every run of benchmark words in a document."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard_id of every document."""
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text, n_lines, n_removed of every document that lines shared across documents do not deplete."""
    return linefreq.clean_documents(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, text, n_lines, n_removed of every page without its site's boilerplate."""
    return linefreq.clean_pages(_table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op6_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, duplicate_of of every near-duplicate that goes."""
    return simhash.duplicate_pairs(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license_id, containment, start_char, end_char of every license notice in a document."""
    return licenses.license_notices(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and both scores of every document that passes."""
    return classifier.kept(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, text, n_lines, n_removed of every page without what the page of the nearest URL has too."""
    return pagediff.own_text(_table(spark, sf_dir, "pages"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy: one row for each document of the mixture."""
    return mixing.copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_kd_sharding,
        op3_quality_rules,
        op4_line_dedup,
        op5_token_counts,
        op6_simhash_duplicates,
        op7_license_scan,
        op8_quality_classifier,
        op9_page_difference,
        op10_mixture,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": linefreq.DOCUMENTS_SQL, "op4_line_dedup": linefreq.PAGES_SQL, "op10_mixture": mixing.SQL}
