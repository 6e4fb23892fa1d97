"""Context packs: hits expanded to neighbours or sections, merged, resolved and budgeted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from quillstack.functions import jstext as js
from quillstack.operators.index import Index
from quillstack.operators.search import SearchOptions, search

SCOPE = "struct<type:string,sectionId:string,range:struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class RetrievalOptions:
    limit: int = 5
    per_hit_neighbors: int = 1
    expand: str = "neighbors"
    max_tokens: int | None = None
    rank: str = "tfidf"


def neighbors(spans: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(corpus_id, span_id, ord, neighbors): ids around each span of the corpus, clipped at its ends."""
    frame = W.partitionBy("corpus_id").orderBy("ord").rowsBetween(-before, after)
    return spans.select("corpus_id", "span_id", "ord", F.collect_list("span_id").over(frame).alias("neighbors"))


def neighbors_of(spans: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(corpus_id, span_id, neighbor_id, neighbor_ord, is_target) of hits (corpus_id, span_id, ord): each hit
    names the orders around it, so the join is by equality whatever the number of hits."""
    h = hits.select("corpus_id", F.col("span_id").alias("hit_id"), F.col("ord").alias("o"), F.explode(F.sequence(F.col("ord") - before, F.col("ord") + after)).alias("ord"))
    return spans.join(h, ["corpus_id", "ord"]).select("corpus_id", F.col("hit_id").alias("span_id"), F.col("span_id").alias("neighbor_id"), F.col("ord").alias("neighbor_ord"), (F.col("ord") == F.col("o")).alias("is_target"))


def expand_to_neighbors(hits: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """hits with pack_id, scope and paragraph_ids of the window of n spans either side. Orders
    are dense, so the ids follow from arithmetic and no span is read."""
    out = hits.join(stats.select("corpus_id", "max_ord"), "corpus_id")
    start, end = F.greatest(F.lit(0).cast("bigint"), F.col("ord") - n), F.least(F.col("max_ord"), F.col("ord") + n)
    out = out.withColumn("s", start).withColumn("e", end)
    scope = F.struct(F.lit("neighbors").alias("type"), F.lit(None).cast("string").alias("sectionId"), F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("range")).cast(SCOPE)
    ids = F.transform(F.sequence("s", "e"), lambda i: js.numbered_id("span", i))
    return out.select(*hits.columns, F.format_string("o:%d-%d", "s", "e").alias("pack_id"), scope.alias("scope"), ids.alias("paragraph_ids"))


def expand_to_section(hits: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """hits with the pack of their section and its heading path; nulls where there is none."""
    out = hits.join(paragraphs.select("corpus_id", "span_id", "section_id"), ["corpus_id", "span_id"], "left").join(sections.select("corpus_id", "section_id", "heading", F.col("paragraph_ids").alias("ids")), ["corpus_id", "section_id"], "left")
    found = F.col("ids").isNotNull()
    scope = F.struct(F.lit("section").alias("type"), F.col("section_id").alias("sectionId"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("range")).cast(SCOPE)
    return out.select(*hits.columns, F.when(found, F.concat(F.lit("s:"), "section_id")).alias("pack_id"), F.when(found, scope).alias("scope"), F.col("ids").alias("paragraph_ids"), F.when(found, js.heading_path_of(F.col("heading"))).alias("section_path"))


def union_ids(ids: Column) -> Column:
    """Distinct ids of several lists, by their number; ids without one come first."""
    number = lambda x: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, "span:(\\d+)", 1), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))
    pairs = F.transform(F.array_distinct(F.flatten(ids)), lambda x: F.struct(number(x).alias("n"), x.alias("id")))
    return F.transform(F.array_sort(pairs), lambda p: p["id"])


def section_packs(hits: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """merge(expand_to_section(hits)) without hits that have no section. Hits are grouped by section first,
    and a section's list of paragraphs is attached once."""
    best = F.max_by(F.struct(*[c for c in hits.columns if c != "corpus_id"]), F.struct(F.col("score"), -F.col("ord")))
    own = hits.join(paragraphs.select("corpus_id", "span_id", "section_id"), ["corpus_id", "span_id"]).groupBy("corpus_id", "section_id").agg(best.alias("b"))
    out = own.join(sections.select("corpus_id", "section_id", "heading", "paragraph_ids"), ["corpus_id", "section_id"]).filter("paragraph_ids is not null")
    scope = F.struct(F.lit("section").alias("type"), F.col("section_id").alias("sectionId"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("range")).cast(SCOPE)
    return out.select("corpus_id", F.concat(F.lit("s:"), "section_id").alias("pack_id"), "b.*", scope.alias("scope"), js.heading_path_of(F.col("heading")).alias("section_path"), union_ids(F.array("paragraph_ids")).alias("paragraph_ids"))


def merge(contexts: DataFrame) -> DataFrame:
    """One row a pack_id: the hit of the highest score (then the lowest ord), its scope and path, and all paragraphs."""
    entry = [c for c in contexts.columns if c not in ("corpus_id", "pack_id", "paragraph_ids")]
    best = F.max_by(F.struct(*entry), F.struct(F.col("score"), -F.col("ord")))
    out = contexts.groupBy("corpus_id", "pack_id").agg(best.alias("b"), union_ids(F.collect_list("paragraph_ids")).alias("paragraph_ids"))
    return out.select("corpus_id", "pack_id", "b.*", "paragraph_ids")


def resolve(packs: DataFrame, spans: DataFrame) -> DataFrame:
    """packs with text, span_count and char_count; ids without a span are left out."""
    ids = packs.select("corpus_id", "pack_id", F.posexplode("paragraph_ids").alias("pos", "span_id"))
    got = ids.join(spans.select("corpus_id", "span_id", "text"), ["corpus_id", "span_id"])
    text = got.groupBy("corpus_id", "pack_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("span_count"))
    return packs.join(text, ["corpus_id", "pack_id"]).withColumn("char_count", js.utf16_length(F.col("text")))


def budget(packs: DataFrame, limit: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """The first packs by score, then ord, until limit or the first that would overflow max_tokens characters."""
    by = W.partitionBy("corpus_id").orderBy(F.desc("score"), "ord")
    out = packs.withColumn("rank", F.row_number().over(by))
    if max_tokens is not None:
        out = out.withColumn("used", F.sum("char_count").over(by.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("used") <= max_tokens).drop("used")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def retrieve(index: Index, query: str, options: RetrievalOptions | None = None) -> DataFrame:
    """(corpus_id, rank, pack_id, span_id, ord, score, tokens, phrases, scope, paragraph_ids,
    text, heading_path, span_count, char_count) of the best packs of each corpus."""
    o = options or RetrievalOptions()
    hits = search(index, query, SearchOptions(limit=o.limit * 4, rank=o.rank)).drop("rank")
    hits = hits.join(index.spans.select("corpus_id", "span_id", "heading_path"), ["corpus_id", "span_id"])
    near = expand_to_neighbors(hits, index.stats, o.per_hit_neighbors)
    if o.expand == "section" and index.sections is not None:
        within = section_packs(hits, index.paragraphs, index.sections).withColumn("heading_path", F.col("section_path")).drop("section_path")
        placed = index.paragraphs.join(index.sections.filter("paragraph_ids is not null").select("corpus_id", "section_id"), ["corpus_id", "section_id"])
        outside = near.join(placed.select("corpus_id", "span_id"), ["corpus_id", "span_id"], "left_anti").select(near.columns)
        packs = within.unionByName(merge(outside))
    else:
        packs = merge(near)
    return budget(resolve(packs, index.spans), o.limit, o.max_tokens)
