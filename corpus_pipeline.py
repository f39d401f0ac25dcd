"""From documents to training sequences: quality, rules, near-duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. The first
three return the columns of ``documents`` for the rows that stay; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.binpack import pack_sequences
from marketloom.llm.bytecnn import fit_quality, quality_score
from marketloom.llm.oddsketch import near_duplicates
from marketloom.llm.shared import saved
from marketloom.llm.zbands import compression_bands

#: A document whose score is lower goes.
QUALITY_LIMIT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on a bounded sample of labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    net = fit_quality(docs.select("doc_id", "text"), labels)
    return docs.where(quality_score(F.col("text"), net) >= QUALITY_LIMIT)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and compression bands."""
    return docs.where(compression_bands(F.col("text"))["kept"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group; of rows with equal doc_id and text one stays, and all without a doc_id."""
    kept = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept"))
    stays = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return stays.unionByName(docs.where(F.col("doc_id").isNull()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents in as few sequences of 1024 tokens as the scheme finds."""
    crc = {"ids_crc32": F.crc32("ids")}
    return pack_sequences(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, columns=crc)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("rules", rules),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL cannot express the network, zstandard, the sketches or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
