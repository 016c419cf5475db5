"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on, with the columns of ``documents``; the last one
adds ``shard_id``.  Every stage sees all that the one before it kept.

Defined results: documents with a null, empty or wordless text go in the first stage;
of rows that repeat one stays in the second; a null doc_id, lang or source is a value
like others; texts of any length pass whole; an empty table gives an empty result with
the same columns; further columns pass through under any name, and where one is called
``shard_id`` the last stage's column is ``shard_id_``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import classifier, decontam, mixing, sharding, simhash
from tracewell.plans.lineage import standing, sweep, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the low-quality or the toxicity model rejects."""
    return classifier.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a run of benchmark words."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and drops documents so that the sources have their target weights."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document."""
    return sharding.with_shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixture", mixture),
    ("sharding", sharded),
]

#: The classifier and SimHash cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. A stage's tables go once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), standing()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        sweep(before, docs)
    return docs
