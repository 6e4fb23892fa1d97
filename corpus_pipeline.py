"""The training-data pipeline: quality, lines, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; its result is written and read again.

Defined cases: documents without words, null and empty texts among them, go at the
first stage; null doc_ids pass the second and third stage as they are, and are told
apart by no stage; rows with the same doc_id are one document to these stages and tie
at the last; repeated rows fare alike; very long texts are read whole; an empty table
gives an empty one, and without labels or a benchmark their stage drops nothing but
documents without words; other columns, whatever their names, are kept, but n_chars
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import bagminhash, decontam, lines, mixing, quality
from quillstack.llm.common import drop, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The stages' models and searches are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
