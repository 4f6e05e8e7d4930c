"""From raw documents to packed token ids: a chain of five stages, each written as Parquet before the next."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgersift.llm import decontaminate, mixing, near_dups, packing, quality  # noqa: E402
from ledgersift.llm.tables import scratch, table  # noqa: E402
from ledgersift.session import remove_folder, shared_dir  # noqa: E402


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dups.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shard by shard."""
    return mixing.mixture(docs).rows(docs).drop("__shard")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_packing", pack_tokens),
]

#: SQL cannot fit the classifier, draw the mix or encode. The tests run the stages in order: near copies and token counts
#: against brute force, the other stages against their operators' own rows (verdicts, leaks, draws).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written to the shared folder and read again. What a stage stored on
    its way, and the result before it, are removed when its own result is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
