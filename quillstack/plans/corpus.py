"""A corpus: build it from files, or open it, and ask it."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from quillstack.operators import embed, index as ix, prompt, report, retrieve, search, segment, structure
from quillstack.sources import artifacts, ingest, schemas


class BuildResult(NamedTuple):
    span_count: int
    spans_path: str
    manifest_path: str
    node_map_path: str
    report_path: str


def build(spark: SparkSession, path: str, out: str = "dist", title: str | None = None, fmt: str | None = None) -> BuildResult:
    """Compile one file to the four artifacts."""
    docs = ingest.read_files(spark, path, fmt, title).cache()
    spans = segment.spans(docs).cache()
    n = spans.count()
    if not n:
        raise ValueError("No paragraphs found in input file")
    manifest = ingest.manifests(docs, spans.groupBy("corpus_id").agg(F.count("*").alias("n"))).cache()
    a = structure.assigned(spans, docs).cache()
    spans_path = artifacts.write_spans(artifacts.wire_spans(spans, embed.span_embeddings(spans)), out)
    row = manifest.head()
    manifest_path = artifacts.write_json(row, schemas.MANIFEST, out, "manifest.json")
    node_map_path = artifacts.write_json(structure.node_map(a, manifest).head(), schemas.NODE_MAP, out, "nodeMap.json")
    report_path = artifacts.write_json(report.build(spans, a, manifest).head(), schemas.REPORT, out, "buildReport.json")
    for df in (docs, spans, manifest, a):
        df.unpersist()
    return BuildResult(n, spans_path, manifest_path, node_map_path, report_path)


class Corpus:
    """One loaded corpus. Operators return DataFrames; point accessors return rows or None."""

    def __init__(self, spark: SparkSession, loaded: artifacts.Artifacts):
        self.spark, self.manifest, self.node_map, self.report = spark, loaded.manifest, loaded.node_map, loaded.report
        cid = self.manifest["id"]
        wire = loaded.spans.cache()
        self.spans = wire.select(F.lit(cid).alias("corpus_id"), F.col("id").alias("span_id"), F.col("meta.order").alias("ord"), "text", F.col("meta.headingPath").alias("heading_path"))
        embeddings = wire.filter("size(embedding) > 0").select(F.lit(cid).alias("corpus_id"), F.col("id").alias("span_id"), "embedding")
        sections = paragraphs = None
        if self.node_map:
            rows = [(cid, k, v["meta"]["heading"], v["paragraphIds"]) for k, v in self.node_map["sections"].items()]
            sections = spark.createDataFrame(rows, "corpus_id string, section_id string, heading string, paragraph_ids array<string>")
            paragraphs = sections.select("corpus_id", "section_id", F.explode("paragraph_ids").alias("span_id"))
        self.index = ix.build(self.spans, embeddings, sections, paragraphs)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Corpus:
        return Corpus(spark, artifacts.load(spark, path))

    def enable_tf_cache(self, size: int = 100) -> None:
        """Keeps postings in memory. Results don't change; size is accepted for compatibility."""
        self.index = self.index.cached()

    def get_manifest(self) -> dict:
        return self.manifest

    def get_node_map(self) -> dict | None:
        return self.node_map

    def get_build_report(self) -> dict | None:
        return self.report

    def get_span(self, span_id: str) -> Row | None:
        return self.spans.filter(F.col("span_id") == span_id).head()

    def get_by_order(self, order: int) -> Row | None:
        return self.spans.filter(F.col("ord") == order).head()

    def get_span_count(self) -> int:
        return self.spans.select("span_id").distinct().count()

    def neighbors(self, span_id: str, before: int = 1, after: int = 1) -> list[str]:
        hit = self.spans.filter(F.col("span_id") == span_id)
        rows = retrieve.neighbors_of(self.spans, hit, before, after).orderBy("neighbor_ord").select("neighbor_id").collect()
        return [r[0] for r in rows]

    def get_section(self, section_id: str) -> list[str] | None:
        found = (self.node_map or {"sections": {}})["sections"].get(section_id)
        return list(found["paragraphIds"]) if found else None

    def list_sections(self) -> list[str]:
        return sorted((self.node_map or {"sections": {}})["sections"])

    def search(self, query: str, **options) -> DataFrame:
        return search.search(self.index, query, search.SearchOptions(**options)).orderBy("rank")

    def retrieve(self, query: str, **options) -> DataFrame:
        return retrieve.retrieve(self.index, query, retrieve.RetrievalOptions(**options)).orderBy("rank")

    def assemble_prompt(self, question: str, packs: DataFrame, style: str = "qa") -> Row:
        corpora = self.spark.createDataFrame([(self.manifest["id"],)], "corpus_id string")
        return prompt.assemble(packs, question, corpora, style).head()


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus.load(spark, os.path.abspath(path))
