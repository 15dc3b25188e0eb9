"""A training corpus from raw documents: each stage's result is written as Parquet and read again as the next one's input.

quality     documents that fail the base rules or the adaptive limits go
near_dedup  of each near-duplicate group one document stays: fingerprints of 5-word shingles in 3 bits or fewer apart, or a
            Jaccard similarity of the shingles of 0.8 or more
benchmark   documents with a benchmark passage go
secrets     secrets in the texts are replaced by [SECRET]; n_chars follows
packing     token sequences; this stage returns pieces
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import decontaminate, packing, quality_rules, secrets, simhash
from seedloom.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, radius=3, shingle=5, similar=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), policy="documents")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.ranks_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("benchmark", benchmark), ("secrets", secret_scan), ("packing", pack)]

#: Fingerprints and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
