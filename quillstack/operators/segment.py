"""Documents to spans: paragraphs, ids, headings and heading paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from quillstack.functions import jstext as js

MARKDOWN = ("md", "markdown")


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """(corpus_id, ord, text, format) of normalised docs (corpus_id, text, format); no shuffle."""
    return docs.select("corpus_id", "format", F.posexplode(js.paragraphs(F.col("text"))).alias("ord", "text")).select("corpus_id", F.col("ord").cast("bigint").alias("ord"), "text", "format")


def with_headings(spans: DataFrame) -> DataFrame:
    return spans.withColumn("level", js.heading_level(F.col("text"))).withColumn("heading", F.when(F.col("level") > 0, js.heading_text(F.col("text"))))


def with_heading_paths(spans: DataFrame) -> DataFrame:
    """Adds heading_path. A heading resets the deeper levels; a heading itself has its
    parents' path. Only Markdown has paths. One exchange by corpus serves all windows."""
    h = [F.when(F.col("level") == k, F.col("heading")) for k in (1, 2, 3)]
    by = W.partitionBy("corpus_id").orderBy("ord")
    out = with_headings(spans)
    out = out.withColumn("h1", F.last(h[0], True).over(by)).withColumn("g1", F.count(h[0]).over(by)).withColumn("g2", F.count(F.when(F.col("level").isin(1, 2), 1)).over(by))
    out = out.withColumn("h2", F.last(h[1], True).over(W.partitionBy("corpus_id", "g1").orderBy("ord")))
    out = out.withColumn("h3", F.last(h[2], True).over(W.partitionBy("corpus_id", "g2").orderBy("ord")))
    own = lambda k: F.when((F.col("level") == 0) | (F.col("level") > k), F.col(f"h{k}"))
    path = F.array_compact(F.array(own(1), own(2), own(3)))
    path = F.when(F.lower("format").isin(*MARKDOWN), path).otherwise(F.array().cast("array<string>"))
    return out.withColumn("heading_path", path).drop("h1", "h2", "h3", "g1", "g2", "heading")


def spans(docs: DataFrame) -> DataFrame:
    """(corpus_id, span_id, ord, text, level, heading_path) of normalised docs."""
    out = with_heading_paths(split_paragraphs(docs))
    return out.select("corpus_id", js.numbered_id("span", F.col("ord")).alias("span_id"), "ord", "text", "level", "heading_path")


def merged_corpus(lines: DataFrame, corpus_id: str, key: str = "corpus_id", chunk: int = 4096) -> DataFrame:
    """The spans of many corpora as one corpus, ordered by an integer key and ord: a two-level
    prefix sum over counts gives each document's offset, so no window spans all rows."""
    counts = lines.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).withColumn("c", F.floor(F.col("k") / chunk))
    totals = counts.groupBy("c").agg(F.sum("n").alias("t"))
    totals = totals.select("c", (F.sum("t").over(W.orderBy("c")) - F.col("t")).alias("base"))
    inner = counts.withColumn("before", F.sum("n").over(W.partitionBy("c").orderBy("k")) - F.col("n"))
    offset = inner.join(totals, "c").select(F.col("k").alias(key), (F.col("base") + F.col("before")).alias("offset"))
    out = lines.join(offset, key).withColumn("ord", F.col("offset") + F.col("ord")).drop("offset")
    return out.withColumn("source_key", F.col(key)).withColumn("corpus_id", F.lit(corpus_id)).withColumn("span_id", js.numbered_id("span", F.col("ord")))
