"""What showed only on larger tables: ties, and steps that grew faster than their input."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstack.functions import jstext as js, tokens as tk
from quillstack.operators import embed, index as ix, search as se
from quillstack.plans import catalog, store


def corpus(spark, texts, name="c"):
    rows = [(name, f"span:{i + 1:06d}", i, t, []) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "corpus_id string, span_id string, ord bigint, text string, heading_path array<string>")


def test_near_ties_rank_by_the_logarithms_of_c(spark):
    """(1 + ln 1) + (1 + ln 6) and (1 + ln 2) + (1 + ln 3) are equal but for the last bits, in which the JVM's differ."""
    texts = ["the the of of of" + " x" * 7, "the of of of of of of" + " x" * 5]
    idf = math.log(2 / 3)
    score = [((1 + math.log(a)) * idf + (1 + math.log(b)) * idf) / math.sqrt(12) for a, b in ((2, 3), (1, 6))]
    got = se.search(ix.build(corpus(spark, texts)), "the of", se.SearchOptions(rank="tfidf")).orderBy("rank").collect()
    assert [r.ord for r in got] == sorted((0, 1), key=lambda i: (-score[i], i))
    assert [r.score for r in got] == [score[r.ord] for r in got]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


TEXTS = ["", "The cat, the CAT; the dog", None, "!!", "a1\u00e9b2", "x" * 70_000, "\u4e2d the \u212a", "z z z"]


def test_postings_are_counted_without_a_shuffle(spark):
    found = ix.postings(corpus(spark, TEXTS))
    assert "Aggregate" not in plan_of(found) and "Exchange" not in plan_of(found)
    expected = Counter()
    for i, t in enumerate(TEXTS):
        words = re.findall("[a-z0-9]+", (t or "").lower())
        expected.update({(w, i, k, len(words)): 1 for w, k in Counter(words).items()})
    assert Counter((r.token, r.ord, r.tf, r.doc_len) for r in found.collect()) == expected


def test_pieces_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a" * 5, "", "b" * 30, *["c" * 4] * 9]), pa.array(range(13))], names=["text", "i"])
    for most in (1, 8, 20, 1000):
        parts = list(tk.pieces(iter([batch, batch.slice(0, 0), batch]), most=most))
        assert [i for p in parts for i in p.column("i").to_pylist()] == [*range(13), *range(13)]
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) < 2 * most + 30 for p in parts)


def test_vectors_are_those_of_the_text(spark):
    got = embed.span_embeddings(corpus(spark, TEXTS)).collect()
    for r, t in zip(sorted(got, key=lambda r: r.span_id), TEXTS, strict=True):
        assert np.allclose(r.embedding, embed.embed_text(t or ""), atol=1e-12)
    tokens = spark.createDataFrame([("section",), ("a",)], "token string")
    assert "Aggregate" not in plan_of(embed.token_summaries(tokens))
    for r in embed.token_summaries(tokens).collect():
        v = embed.token_vectors([r.token])[0]
        assert r.dims == len(v) and np.allclose([r.total, r.low, r.high], [v.sum(), v.min(), v.max()])


def test_heading_levels_of_odd_paragraphs(spark):
    texts = ["# a", "##  b ", "####x", "#x", "# ", "#  ", "#\nfoo", "# a\nb", "#\n", "#\u2028x", "##\ty\r", "", None, "a # b", "#\n x", "#\n ", "#" * 3 + " z z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    level = F.length(F.regexp_extract("t", js.HEADING, 1))
    text = F.when(level > 0, js.trim(F.regexp_extract("t", js.HEADING, 2)))
    for r in df.select(js.heading_level(F.col("t")).alias("a"), level.alias("b"), js.heading_text(F.col("t")).alias("c"), text.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)


def test_sections_need_no_postings(spark, monkeypatch):
    def refuse(df, *codec):
        assert "tf" not in df.columns, "postings were written"
        return df

    monkeypatch.setattr(store, "written", refuse)
    monkeypatch.setattr(store, "_kept", {})
    assert catalog.QUERIES["get_section"](spark, "/root/testdata/sf0.001").columns == ["corpus_id", "ids"]


def test_batch_search_shuffles_no_postings(spark):
    index = ix.build(corpus(spark, ["the cat sat", "the dog", "a cat and the dog", "the the cat"]))
    index = index._replace(**{k: store.written(getattr(index, k)) for k in ("spans", "postings", "terms", "stats")})
    found = se.batch_search(index, spark.createDataFrame([(1, "the cat"), (2, "dog the the"), (3, "none cat")], "query_id int, text string"), 10)
    assert sorted((r.query_id, r.ord) for r in found.collect()) == [(1, 0), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert "SortMergeJoin" not in plan_of(found)


def test_semantic_scores(spark):
    rows = [("c", "a", [1.0, 2.0]), ("c", "b", []), ("c", "d", None), ("c", "e", [3.0, -1.0])]
    df = spark.createDataFrame(rows, "corpus_id string, span_id string, embedding array<double>")
    assert {r.span_id: r.semantic for r in embed.semantic_scores(df, [2.0, 1.0]).collect()} == {"a": 4.0, "b": None, "d": None, "e": 5.0}


def test_some_terms_are_cached(spark):
    index = ix.build(corpus(spark, ["the cat sat", "the dog"]))
    some = index.cached("the", "dog")
    assert {r.token for r in some.postings.collect()} == {"the", "dog"} and some.terms.count() == 2
    got, whole = ({(r.span_id, r.score) for r in se.tfidf(i, "the dog").collect()} for i in (some, index))
    assert got == whole
