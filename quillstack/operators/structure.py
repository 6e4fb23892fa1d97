"""The chapter and section hierarchy, by prefix sums over heading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from quillstack.functions import jstext as js


def assigned(spans: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """spans with section_id, chapter_id and section_heading. A chapter opens at a first-level
    heading or at the first span, a section at those and at second-level headings. A section
    is headed by the second-level heading that opened it; in a corpus without any heading the
    only section is headed by the corpus's title, from titles (corpus_id, title)."""
    by = W.partitionBy("corpus_id").orderBy("ord")
    first = F.row_number().over(by) == 1
    out = spans.withColumn("c", F.when((F.col("level") == 1) | first, 1).otherwise(0)).withColumn("s", F.when(F.col("level").isin(1, 2) | first, 1).otherwise(0))
    out = out.withColumn("ci", F.sum("c").over(by) - 1).withColumn("si", F.sum("s").over(by) - 1)
    out = out.withColumn("any_heading", F.max("level").over(W.partitionBy("corpus_id")) > 0)
    opened = F.first(F.when(F.col("level") == 2, F.col("text")).otherwise("")).over(W.partitionBy("corpus_id", "si").orderBy("ord"))
    out = out.withColumn("opened", opened)
    if titles is not None:
        out = out.join(titles.select("corpus_id", F.col("title").alias("t")), "corpus_id", "left")
    else:
        out = out.withColumn("t", F.lit(""))
    out = out.withColumn("section_heading", F.when(F.col("any_heading"), F.col("opened")).otherwise(F.coalesce("t", F.lit(""))))
    out = out.withColumn("section_id", js.numbered_id("sec", F.col("si"))).withColumn("chapter_id", js.numbered_id("chap", F.col("ci")))
    return out.drop("c", "s", "ci", "si", "any_heading", "opened", "t")


def _ordered(column: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: x[column])


def paragraphs(a: DataFrame) -> DataFrame:
    return a.select("corpus_id", "span_id", "ord", "section_id")


def sections(a: DataFrame) -> DataFrame:
    """(corpus_id, section_id, chapter_id, heading, paragraph_ids, first_ord)."""
    return a.groupBy("corpus_id", "section_id").agg(F.min("chapter_id").alias("chapter_id"), F.min("section_heading").alias("heading"), _ordered("span_id").alias("paragraph_ids"), F.min("ord").alias("first_ord"))


def chapters(a: DataFrame) -> DataFrame:
    """(corpus_id, chapter_id, section_ids)."""
    first = a.groupBy("corpus_id", "chapter_id", "section_id").agg(F.min("ord").alias("ord"))
    return first.groupBy("corpus_id", "chapter_id").agg(_ordered("section_id").alias("section_ids"))


def node_map(a: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row a corpus in the wire format: book, chapters, sections and paragraphs as maps."""
    s, c = sections(a), chapters(a)
    paragraph = a.groupBy("corpus_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("span_id", F.struct(F.col("section_id").alias("sectionId")))))).alias("paragraphs"))
    section = s.groupBy("corpus_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_id", F.struct(F.col("paragraph_ids").alias("paragraphIds"), F.struct("heading").alias("meta")))))).alias("sections"))
    empty = F.from_json(F.lit("{}"), "map<string,string>").alias("meta")
    chapter = c.groupBy("corpus_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter_id", F.struct(F.col("section_ids").alias("sectionIds")))))).alias("chapters"))
    chapter = chapter.withColumn("chapters", F.transform_values("chapters", lambda _, v: F.struct(v["sectionIds"].alias("sectionIds"), empty)))
    book = manifests.select("corpus_id", F.struct("id", "title").alias("book"))
    return book.join(chapter, "corpus_id").join(section, "corpus_id").join(paragraph, "corpus_id")
