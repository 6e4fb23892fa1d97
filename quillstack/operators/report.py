"""The build report: summary, length statistics, warnings and samples of each corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstack.functions import jstext as js

SHORT, LONG = 20, 2000


def measured(spans: DataFrame) -> DataFrame:
    return spans.withColumn("chars", js.utf16_length(F.col("text")))


def percentile(p: int) -> Column:
    """Nearest rank over chars; keeps counts of distinct lengths, not the lengths."""
    return F.expr(f"CAST(percentile_disc({p / 100}) WITHIN GROUP (ORDER BY chars) AS BIGINT)")


def statistics(spans: DataFrame) -> DataFrame:
    """One row a corpus with every measure that a single pass gives."""
    least, most = F.struct("chars", "ord"), F.struct(F.col("chars"), -F.col("ord"))
    ref = F.struct("span_id", "ord", "chars", "text")
    out = measured(spans).groupBy("corpus_id").agg(
        F.count("*").alias("span_count"),
        F.sum("chars").alias("total_chars"),
        F.count_if(F.contains("text", F.lit("\n"))).alias("multi_line_spans"),
        F.min_by(ref, least).alias("shortest"),
        F.max_by(ref, most).alias("longest"),
        F.count_if(F.col("chars") < SHORT).alias("short_spans"),
        F.count_if(F.col("chars") > LONG).alias("long_spans"),
        *[percentile(p).alias(f"p{p}") for p in (10, 50, 90)],
    )
    return out.withColumn("avg_chars", js.round2(F.col("total_chars") / F.col("span_count")))


def duplicate_texts(spans: DataFrame) -> DataFrame:
    """(corpus_id, duplicate_texts): distinct texts that occur more than once."""
    many = spans.groupBy("corpus_id", "text").agg((F.count("*") > 1).cast("int").alias("d"))
    return many.groupBy("corpus_id").agg(F.sum("d").alias("duplicate_texts"))


def build(spans: DataFrame, assigned: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """One row a corpus in the wire format."""
    counts = assigned.groupBy("corpus_id").agg(F.count_distinct("chapter_id").alias("chapters"), F.count_distinct("section_id").alias("sections"))
    t = statistics(spans).join(duplicate_texts(spans), "corpus_id").join(counts, "corpus_id")
    ref = lambda c: F.struct(F.col(f"{c}.chars").alias("chars"), F.col(f"{c}.span_id").alias("id"), F.col(f"{c}.ord").alias("order"))
    sample = lambda c: js.truncate(F.col(f"{c}.text"))
    out = t.select(
        "corpus_id",
        F.struct(F.col("span_count").alias("spanCount"), F.col("total_chars").alias("totalChars"), F.col("avg_chars").alias("avgCharsPerSpan"), F.col("multi_line_spans").alias("multiLineSpans"), F.col("chapters").alias("chapterCount"), F.col("sections").alias("sectionCount")).alias("summary"),
        F.struct(ref("shortest").alias("min"), ref("longest").alias("max"), "p10", "p50", "p90").alias("lengthStats"),
        F.struct(F.lit(SHORT).cast("bigint").alias("shortSpanChars"), F.lit(LONG).cast("bigint").alias("longSpanChars")).alias("thresholds"),
        F.struct(F.col("short_spans").alias("shortSpans"), F.col("long_spans").alias("longSpans"), F.col("duplicate_texts").alias("duplicateTexts")).alias("warnings"),
        F.struct(sample("shortest").alias("shortest"), sample("longest").alias("longest")).alias("samples"),
    )
    if manifests is not None:
        keys = ("id", "sourceHash", "createdAt", "version", "format", "detection")
        out = out.join(manifests.select("corpus_id", F.struct(*keys).alias("provenance")), "corpus_id")
    return out
