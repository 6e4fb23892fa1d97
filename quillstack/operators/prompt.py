"""Prompts with citations from ranked packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstack.functions import jstext as js

#: By style; any other style is taken as "summarize". The wording is this library's own.
SYSTEM_PROMPTS = {
    "qa": "Answer the question from the context below and from nothing else. Mark every statement with the number of its source, as in [¹] or [²]. Where the context is not enough, say so plainly; never guess.",
    "summarize": "Summarize the context below briefly and faithfully. Mark every statement with the number of its source, as in [¹] or [²]. Leave out whatever the context does not say.",
}


def system_prompt(style: str) -> str:
    return SYSTEM_PROMPTS["qa" if style == "qa" else "summarize"]


def span_offsets(phrases: Column) -> Column:
    """[start, end] of every phrase range, or null without any."""
    pairs = F.flatten(F.transform(phrases, lambda p: F.transform(p["ranges"], lambda r: F.array(r["start"], r["end"]))))
    return F.when(F.size(pairs) > 0, pairs)


def context_block(marker: Column, doc_id: Column, heading_path: Column, text: Column) -> Column:
    path = F.when(F.size(heading_path) > 0, F.concat(F.lit("Path: "), F.array_join(heading_path, " > ")))
    return F.concat_ws("\n", marker, F.concat(F.lit("Doc: "), doc_id), path, F.lit("---"), text)


def citations(packs: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """(corpus_id, rank, marker, pack_id, doc_id, heading_path, span_offsets, block), numbered in pack order."""
    doc_id = F.col("corpus_id") if doc_id is None else doc_id
    marker = js.superscript_marker(F.col("rank"))
    return packs.select("corpus_id", "rank", marker.alias("marker"), "pack_id", doc_id.alias("doc_id"), "heading_path", span_offsets(F.col("phrases")).alias("span_offsets"), context_block(marker, doc_id, F.col("heading_path"), F.col("text")).alias("block"))


def assemble(packs: DataFrame, question: str, corpora: DataFrame, style: str = "qa", system: str | None = None) -> DataFrame:
    """(corpus_id, prompt, citations, tokensEstimated) of every row of corpora (corpus_id), those without packs included."""
    text = system if system is not None else system_prompt(style)
    c = citations(packs)
    entry = F.struct("rank", "marker", F.col("pack_id").alias("packId"), F.col("doc_id").alias("docId"), F.col("heading_path").alias("headingPath"), F.col("span_offsets").alias("spanOffsets"), "block")
    got = c.groupBy("corpus_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    out = corpora.select("corpus_id").join(got, "corpus_id", "left")
    join = lambda name, sep: F.array_join(F.transform("e", lambda x: x[name]), sep)
    user = F.when(F.col("e").isNull(), F.lit(question)).otherwise(F.concat(F.lit(f"{question}\n\nYou may reference "), join("marker", "…"), F.lit(".\n\n"), join("block", "\n\n")))
    cites = F.coalesce(F.transform("e", lambda x: F.struct(*[x[k].alias(k) for k in ("marker", "packId", "docId", "headingPath", "spanOffsets")])), F.array())
    return out.select("corpus_id", F.struct(F.lit(text).alias("system"), user.alias("user")).alias("prompt"), cites.alias("citations"), (js.utf16_length(F.lit(text)) + js.utf16_length(user)).alias("tokensEstimated"))
