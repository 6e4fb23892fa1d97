from __future__ import annotations

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillstack.functions import jstext as js
from quillstack.operators import embed, fuzzy


def column(spark, values, *functions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *[f(F.col("v")) for f in functions]).orderBy("i").collect()]


def test_headings(spark):
    yes = ["# A", "#\nfoo", "## a\u0085b", "# x", "###  c "]
    no = ["# A\nB", "####  x", "#x", "plain", ""]
    got = column(spark, yes + no, js.heading_level, js.heading_text)
    assert got == [(1, "A"), (1, "foo"), (2, "a\u0085b"), (1, "x"), (3, "c")] + [(0, None)] * 5


def test_tokens_and_phrases(spark):
    assert column(spark, ["Here's a **café**", "", None], js.tokenize) == [(["here", "s", "a", "caf"],), ([],), (None,)]
    assert js.parse_query('"section two" secton ""') == (["section two"], ["secton"])
    assert js.parse_query('open "quote') == ([], ["open", "quote"])
    got = column(spark, ["the cat the cat", "a", ""], lambda c: js.phrase_ranges(c, "the"))
    assert [[(r.start, r.end) for r in g[0]] for g in got] == [[(0, 3), (8, 11)], [], []]


def test_normalize(spark):
    texts = ["﻿ a\r\nb\rc \n\n\n\nd ", "é", "", None, "\u0085x"]
    assert [g[0] for g in column(spark, texts, js.normalize_text)] == ["a\nb\rc \n\nd", "é", "", None, "\u0085x"]


def test_paths(spark):
    got = column(spark, ["/a/B.MD", "/a/.bashrc", "/a/x", "/a/x.tar.gz", "/a/x."], js.detect_format, js.extract_title)
    assert got == [("md", "B"), ("", ""), ("", ""), ("gz", "x.tar"), ("", "x")]


def test_ids_markers_and_lengths(spark):
    df = spark.range(1).select(js.numbered_id("span", F.lit(999_999)), js.numbered_id("span", F.lit(0)), js.superscript_marker(F.lit(120)), js.utf16_length(F.lit("a😀")), js.round2(F.lit(51.114)))
    assert tuple(df.first()) == ("span:1000000", "span:000001", "[¹²⁰]", 3, 51.11)


def test_embedding_values(spark):
    v = embed.token_vectors(["section", "a"])
    assert np.allclose(v[0, [0, 1, 2, 100, 127]], [-1.3114, -1.3112, -1.311, 0.0424, 0.0562])
    assert np.allclose(v[1, [0, 1, 2, 100, 127]], [0.0126, 0.0128, 0.0130, 0.6080, 0.6218])
    e = embed.embed_text("section")
    assert np.allclose(e[[0, 1, 2, 10, 100]], [-0.170176, -0.170150, -0.170124, 0.085438, 0.005502], atol=1e-6)
    assert not embed.embed_text("!!").any()
    rows = embed.token_embedding_rows(spark.createDataFrame([("section",), ("a",)], "token string")).collect()
    assert all(abs(r.value - v[["section", "a"].index(r.token), r.dim]) < 1e-9 for r in rows) and len(rows) == 256


def test_dimension_mismatch(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="Vector dimension mismatch: 2 vs 3"):
        embed.cosine_scores(df, [1.0, 2.0, 3.0]).collect()


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=1, max_size=5), st.text("abc", min_size=1, max_size=5))
def test_neighborhood_is_edit_distance_one(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i, *(0 for _ in y)] and _next(row, i, c, y)
        return row[-1]

    def _next(row, i, c, y):
        out = [i]
        for j, d in enumerate(y, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
        return out

    assert (b in fuzzy.neighborhood(a)) == (distance(a, b) == 1) or a == b


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=8), max_size=5))
def test_nfc_array(texts):
    import pyarrow as pa

    assert js._nfc_array(pa.array(texts, pa.string())).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]
