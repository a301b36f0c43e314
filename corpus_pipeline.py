"""The corpus pipeline: documents in, packed rows of token ids out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from facetspark.llm import decontamination, mixing, packing, quality, simhash
from facetspark.llm.common import documents
from facetspark.sources.tables import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands keep."""
    return quality.keep_prose(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least id: fingerprints within 2 bits, or five-word Jaccard of 0.8 or more."""
    return simhash.keep_one(docs, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_rows),
]

#: Compression ratios, SimHash fingerprints and tokenizers are not SQL; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the stage before kept, written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{n}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{n}")
    return docs
