"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept: language ID drops documents that no language explains, near-dedup keeps
one document of each group, the secret scan masks live-looking secrets, mixing samples to the target weights, packing fills
the sequences. SQL can't express the first two, so there is no ORACLE_SQL; tests/llm compares the pipeline with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamsift.llm import langid, minhash, mixing, packing, secret_scan
from loamsift.llm.common import shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_live(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, tokens=packing.count_tokens(docs["text"]))  # the tokens that packing counts


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each one's rows written to the shared folder and read again; the driver deletes
    them as it exits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
