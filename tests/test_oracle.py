"""Every registered query of the reference's operators against its SQL, and structural invariants."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import retrieve, segment, structure
from quillstack.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert list(a.dtypes) == list(b.dtypes)
    assert a.fillna("-").astype(str).equals(b.fillna("-").astype(str))


def imperative(levels, texts):
    """Heading paths and sections, one span after another."""
    stack, out, section, chapter = {}, [], 0, 0
    for i, (level, text) in enumerate(zip(levels, texts, strict=True)):
        if level:
            path = [stack[k] for k in sorted(stack) if k < level]
            stack = {k: v for k, v in stack.items() if k < level} | {level: text}
        else:
            path = [stack[k] for k in sorted(stack)]
        section += level in (1, 2) or i == 0
        chapter += level == 1 or i == 0
        out.append((path, f"sec:{section:06d}", f"chap:{chapter:06d}"))
    return out


def test_structure_against_a_loop(spark):
    rng, rows, expected = random.Random(3), [], {}
    for k in range(60):
        levels = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 12))]
        texts = [f"t{k}x{i}" for i in range(len(levels))]
        rows.append((f"c{k}", "\n\n".join("#" * v + " " * (v > 0) + t for v, t in zip(levels, texts, strict=True)), "md"))
        expected[f"c{k}"] = imperative(levels, texts)
    spans = segment.spans(spark.createDataFrame(rows, "corpus_id string, text string, format string"))
    got = {}
    for r in structure.assigned(spans).orderBy("corpus_id", "ord").collect():
        got.setdefault(r.corpus_id, []).append((r.heading_path, r.section_id, r.chapter_id))
    assert got == expected


def test_two_level_offsets(spark):
    docs = spark.createDataFrame([(str(i), "\n\n".join(["x"] * (i % 3 + 1)), "txt") for i in range(50)], "corpus_id string, text string, format string")
    lines = segment.split_paragraphs(docs).withColumn("k", F.col("corpus_id").cast("bigint"))
    merged = segment.merged_corpus(lines, "all", "k", chunk=7).orderBy("ord").collect()
    assert [r.ord for r in merged] == list(range(len(merged))) and [r.k for r in merged] == sorted(r.k for r in merged)


def test_union_ids(spark):
    df = spark.createDataFrame([([["span:000010", "span:000002"], ["odd", "span:000002"]],)], "ids array<array<string>>")
    assert df.select(retrieve.union_ids(F.col("ids"))).first()[0] == ["odd", "span:000002", "span:000010"]
