"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillstack.llm import bagminhash, bitslice, decontam, htmlx, lines, lm, mixing, pii, quality, substr
from quillstack.plans.store import spread


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_t(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a secret of the session; these tables are invented, so without one they get a public key."""
    key = spark.conf.get("spark.quillstack.pii.key", "for invented tables only")
    return pii.replace_entities(_t(spark, sf_dir, "documents"), key.encode()).select("doc_id", "text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlx.extract(_t(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.nearest(_t(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.dedup(_t(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removals(_t(spark, sf_dir, "documents"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_decontamination, op3_pii_surrogates, op4_html_extraction, op5_quality, op6_exact_topk, op7_substring_dedup, op8_line_dedup, op9_bagminhash, op10_mixing)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op6_exact_topk": bitslice.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
