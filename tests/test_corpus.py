"""The behaviour of a built corpus, on the two small samples."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from quillstack import cli
from quillstack.operators.fuzzy import FuzzyOptions
from quillstack.operators.search import HybridOptions
from quillstack.plans import corpus as c
from quillstack.sources import ingest

#: Two small sample texts.
INPUT = Path(__file__).parent / "data"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = {}
    for name in ("sample.md", "sample.txt"):
        path = str(tmp_path_factory.mktemp(name))
        out[name] = (c.build(spark, str(INPUT / name), path), path)
    return out


@pytest.fixture(scope="module")
def md(spark, built):
    x = c.open_corpus(spark, built["sample.md"][1])
    x.enable_tf_cache()
    return x


def ids(rows):
    return [r.span_id[-6:] for r in rows.collect()]


def scored(rows):
    return [(r.span_id[-6:], round(r.score, 6)) for r in rows.collect()]


def test_build(built, md):
    assert built["sample.md"][0].span_count == 9 and built["sample.txt"][0].span_count == 4
    m = md.get_manifest()
    assert m["sourceHash"].startswith("47cc5c6c54d395f2") and m["byteLength"] == 477 and (m["format"], m["detection"]) == ("md", "auto")
    assert [r.heading_path for r in md.spans.orderBy("ord").collect()][1:6] == [["Sample Markdown Document"]] * 2 + [["Sample Markdown Document", "Section Two"]] * 2 + [["Sample Markdown Document", "Section Two", "Subsection"]]
    r = md.get_build_report()
    assert r["summary"] == {"spanCount": 9, "totalChars": 460, "avgCharsPerSpan": 51.11, "multiLineSpans": 2, "chapterCount": 1, "sectionCount": 3}
    assert r["lengthStats"]["min"] == {"chars": 14, "id": "span:000003", "order": 2} and r["lengthStats"]["max"]["id"] == "span:000002"
    assert [r["lengthStats"][k] for k in ("p10", "p50", "p90")] == [14, 47, 119] and r["warnings"] == {"shortSpans": 3, "longSpans": 0, "duplicateTexts": 0}


def test_text_sample(spark, built):
    x = c.open_corpus(spark, built["sample.txt"][1])
    assert x.get_manifest()["sourceHash"].startswith("904f64c3578a08a3")
    assert x.list_sections() == ["sec:000001"] and x.get_node_map()["sections"]["sec:000001"]["meta"]["heading"] == "sample"
    s = x.get_build_report()["lengthStats"]
    assert (s["min"]["id"], s["max"]["id"], s["p10"], s["p50"], s["p90"]) == ("span:000004", "span:000001", 15, 29, 51)


def test_accessors(md):
    assert md.get_span("span:000003").ord == 2 and md.get_span("nope") is None
    assert md.get_by_order(8).span_id == "span:000009" and md.get_by_order(9) is None and md.get_span_count() == 9
    assert md.neighbors("span:000001") == ["span:000001", "span:000002"] and md.neighbors("nope") == []
    assert md.neighbors("span:000005", 2, 0) == ["span:000003", "span:000004", "span:000005"]
    assert md.list_sections() == ["sec:000001", "sec:000002", "sec:000003"]
    assert md.get_section("sec:000003") == ["span:000007", "span:000008", "span:000009"] and md.get_section("x") is None
    headings = [md.get_node_map()["sections"][s]["meta"]["heading"] for s in md.list_sections()]
    assert headings == ["", "## Section Two", "## Section Three"]


def test_search(md):
    fuzzy = FuzzyOptions(enabled=True)
    assert ids(md.search("section")) == ["000003", "000004", "000006", "000007"]
    assert ids(md.search("section", limit=2)) == ["000003", "000004"] and len(ids(md.search("section", limit=0))) == 1
    assert scored(md.search("section", rank="tfidf")) == [("000003", 0.415628), ("000007", 0.415628), ("000004", 0.207814), ("000006", 0.138543)]
    assert scored(md.search("section two", rank="tfidf")) == [("000003", 1.192464), ("000004", 0.596232)]
    assert scored(md.search("the", rank="tfidf")) == [("000002", 0.415934), ("000004", 0.388418)]
    rows = md.search('"section two"', rank="tfidf").collect()
    assert [(r.span_id[-6:], round(r.score, 6), [(x.start, x.end) for x in r.phrases[0].ranges]) for r in rows] == [("000003", 1.292464, [(0, 11)]), ("000004", 0.696232, [(35, 46)])]
    rows = md.search("secton", rank="tfidf", fuzzy=fuzzy).collect()
    assert [(r.span_id[-6:], r.score) for r in rows] == [("000003", 0.0), ("000004", 0.0), ("000006", 0.0), ("000007", 0.0)]
    assert rows[0].tokens[0].asDict() == {"term": "secton", "fuzzy": True}
    assert scored(md.search('"section two" secton', rank="tfidf", fuzzy=fuzzy)) == [("000003", 1.227841), ("000004", 0.66142)]
    for nothing in ("secton", "", '""', "nonexistentxyz123", '"!!!"'):
        assert ids(md.search(nothing)) == []
    assert ids(md.search('"section tw"')) and not ids(md.search('"ection two"')) and ids(md.search('two "ection two"'))


def test_hybrid(md):
    got = scored(md.search("section", rank="hybrid"))
    assert got == [("000007", 1.0), ("000003", 0.813564), ("000004", 0.175), ("000006", 0.019556)]
    assert [g[0] for g in scored(md.search("paragraph", rank="hybrid"))] == ["000002", "000004", "000009", "000008", "000006"]
    with pytest.raises(ValueError, match=r"Weight sum cannot exceed 1.0 \(got 1.100\)"):
        md.search("zzz", rank="hybrid", hybrid=HybridOptions(0.8, 0.3))
    with pytest.raises(ValueError, match="limit"):
        md.search("section", limit=-1)


def packs(rows):
    return [(r.pack_id, r.span_id[-6:], r.span_count, r.char_count) for r in rows.collect()]


def test_retrieve(md):
    assert packs(md.retrieve("section")) == [("o:1-3", "000003", 3, 184), ("o:5-7", "000007", 3, 176), ("o:2-4", "000004", 3, 79), ("o:4-6", "000006", 3, 137)]
    assert packs(md.retrieve("section", expand="section")) == [("s:sec:000002", "000003", 4, 184), ("s:sec:000003", "000007", 3, 141)]
    assert [(p[0], p[3]) for p in packs(md.retrieve("paragraph", per_hit_neighbors=3))] == [("o:0-4", 228), ("o:0-6", 351), ("o:4-8", 262), ("o:5-8", 246), ("o:2-8", 327)]
    assert packs(md.retrieve("paragraph", per_hit_neighbors=8)) == [("o:0-8", "000002", 9, 476)]
    assert [p[0] for p in packs(md.retrieve("section", max_tokens=300))] == ["o:1-3"]
    assert packs(md.retrieve("the", limit=10, max_tokens=200)) == [("o:0-2", "000002", 3, 163)]


def test_prompt(md):
    found = md.retrieve('"section two"')
    p = md.assemble_prompt("What is it?", found)
    assert p.prompt.user.startswith("What is it?\n\nYou may reference [¹]…[²].\n\n[¹]\nDoc: corpus:47cc5c6c54d3\nPath: Sample Markdown Document\n---\n")
    assert [x.marker for x in p.citations] == ["[¹]", "[²]"] and p.citations[0].spanOffsets == [[0, 11]]
    assert p.tokensEstimated == len(p.prompt.system) + len(p.prompt.user)
    empty = md.assemble_prompt("Q", md.retrieve("zzz"), style="other")
    assert (empty.prompt.user, empty.citations) == ("Q", []) and empty.prompt.system != p.prompt.system


def test_load_errors(spark, built, tmp_path):
    with pytest.raises(FileNotFoundError, match="Directory not found"):
        c.open_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError, match="Not a directory"):
        c.open_corpus(spark, str(tmp_path / "file"))
    with pytest.raises(FileNotFoundError, match="manifest.json not found in"):
        c.open_corpus(spark, str(tmp_path))
    manifest = Path(built["sample.md"][1], "manifest.json").read_text()
    (tmp_path / "manifest.json").write_text(manifest)
    with pytest.raises(FileNotFoundError, match="spans.jsonl not found in"):
        c.open_corpus(spark, str(tmp_path))
    good = json.dumps({"id": "span:000001", "text": "x", "meta": {"order": 0, "headingPath": []}})
    for bad in ("{", "", json.dumps({"id": "a", "text": "", "meta": {"order": 0, "headingPath": []}}), json.dumps({"id": "a", "text": "b", "meta": {"order": 0}})):
        (tmp_path / "spans.jsonl").write_text(f"{good}\n{bad}\n{good}\n")
        with pytest.raises(ValueError, match="Invalid span at line 2"):
            c.open_corpus(spark, str(tmp_path))
    (tmp_path / "spans.jsonl").write_text(good + "\n")
    assert c.open_corpus(spark, str(tmp_path)).list_sections() == []
    (tmp_path / "manifest.json").write_text(manifest.replace('"spanCount": 9', '"spanCount": -1'))
    with pytest.raises(ValueError, match="Failed to load manifest.json"):
        c.open_corpus(spark, str(tmp_path))


def test_formats():
    assert ingest.supported_formats() == ["markdown", "md", "text", "txt"]
    assert ingest.detect_format("a.md", ".TXT") == "txt" and ingest.detect_format("a.b.MD") == "md" and ingest.detect_format("x") == ""
    with pytest.raises(ValueError, match="No reader found for format 'pdf'"):
        ingest.reader_for("pdf")


def test_cli(spark, built, tmp_path, capsys):
    assert cli.main(["build", str(tmp_path / "none.md")], spark) == 1
    assert cli.main(["build", str(INPUT / "sample.txt"), "-o", str(tmp_path / "o"), "-f", "markdown"], spark) == 0
    assert "Processed 4 span(s)" in capsys.readouterr().out
    d = built["sample.md"][1]
    assert cli.main(["search", d, "section", "--rank", "hybrid", "--limit", "1"], spark) == 0 and "span:000007" in capsys.readouterr().out
    for args in (["info", d], ["span", d, "span:000001"], ["order", d, "3"], ["context", d, "span:000002"], ["sections", d], ["section", d, "sec:000002"]):
        assert cli.main(args, spark) == 0
    assert cli.main(["span", d, "zzz"], spark) == 1 and cli.main(["info", str(tmp_path / "x")], spark) == 1
    assert cli.wrap_text("aaa bb\ncccccc", 4) == ["aaa", "bb", "cccc", "cc"]


def test_stream(spark, tmp_path):
    from quillstack.streaming import ingest as stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("# A\n\nb\n\nc")
    for turn, n in ((1, 3), (2, 4)):
        stream.append_spans(stream.stream_files(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (source / "b.txt").write_text("d") if turn == 1 else None
