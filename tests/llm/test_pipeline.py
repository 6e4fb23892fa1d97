"""The pipeline: each stage's decisions against brute force on its own input, and the registry."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import bagminhash, decontam, lines, mixing, quality
from quillstack.llm.common import written
from quillstack.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import ODD, brute_lines, brute_mix, near_groups, sw, table, tokens, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 11))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "source_mixing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before, columns = docs.collect(), docs.columns
    kept = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.keep}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        ids, texts = [r.doc_id for r in before], [r.text for r in before]
        if name == "quality_classifier":
            assert set(after) == kept
        elif name == "line_dedup":
            expected = brute_lines(texts, ids)
            lost = sum(len(t.split("\n")) for t in texts) - sum(len(r.text.split("\n")) for r in after.values())
            assert 0.9 * len(expected) <= lost <= 1.1 * len(expected) + 5
            assert all(r.n_chars == len(r.text) and tokens(r.text) for r in after.values())
        elif name == "near_dedup":
            groups = near_groups(texts, ids)
            assert sum((i in after) != (groups[i] == i) for i in ids) <= 1 + 0.05 * sum(groups[i] != i for i in ids)
        elif name == "decontamination":
            items = [tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for i, t in zip(ids, texts, strict=True):
                w = tokens(t)
                grams = set(zip(w, w[1:], w[2:], strict=False))
                score = max([0.0, *(sw(x, w) for x in items if len(grams & set(zip(x, x[1:], x[2:], strict=False))) > 2)])
                assert (i in after) == (score < decontam.THRESHOLD) or abs(score - decontam.THRESHOLD) < 0.1
        else:
            expected = brute_mix([(r.doc_id, r.source, r.text) for r in before], (1.0,))
            assert set(after) == {k[0] for k in expected}
        before = list(after.values())
        assert before


def test_run_matches_the_stages(spark):
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = quality.filter_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = bagminhash.drop_near_duplicates(lines.dedup_documents(docs))
    docs = mixing.select_documents(decontam.drop_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert got == {r.doc_id: r.text for r in docs.collect()}


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names, no rows at all."""
    rng = random.Random(300)
    good = [words(rng, 80) + "." for _ in range(12)]
    docs = table(spark, [*good, good[0], *ODD, good[1], good[2]], [*range(12), 3, *range(100, 100 + len(ODD)), None, None])
    docs = docs.union(docs.limit(2)).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, good[4]), (2, None), (None, good[5]), (3, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, str(tmp_path)))
        rows = kept.collect()
        assert kept.columns == docs.columns and rows and all(tokens(r.text) for r in rows), name
        if name == "near_dedup":
            assert {r.doc_id for r in rows} >= {*range(1, 12)} - {3} and sum(r.doc_id is None for r in rows) == 2
        if name == "decontamination":
            assert 4 not in {r.doc_id for r in rows} and 5 in {r.doc_id for r in rows}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
