"""Command line: build a corpus, search it, look into it."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from quillstack.operators.fuzzy import FuzzyOptions
from quillstack.plans import corpus as c


def wrap_text(text: str, width: int) -> list[str]:
    """Greedy lines of at most width; longer words are cut."""
    lines, line = [], ""
    for word in text.replace("\n", " ").split(" "):
        if not word:
            continue
        if line and len(line) + 1 + len(word) <= width:
            line += " " + word
            continue
        if line:
            lines.append(line)
        while len(word) > width:
            lines.append(word[:width])
            word = word[width:]
        line = word
    return [*lines, line] if line else lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstack")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("input")
    b.add_argument("-o", "--out", default="dist")
    b.add_argument("-t", "--title")
    b.add_argument("-f", "--format")
    b.add_argument("-v", "--verbose", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("dir")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--rank", choices=("none", "tfidf", "hybrid"), default="none")
    s.add_argument("--fuzzy", action="store_true")
    for name, extra in (("info", None), ("span", "id"), ("order", "order"), ("context", "id"), ("sections", None), ("section", "id")):
        q = sub.add_parser(name)
        q.add_argument("dir")
        if extra:
            q.add_argument(extra, type=int if extra == "order" else str)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "build" and not os.path.exists(args.input):
        print(f"Error: Input file not found: {args.input}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("quillstack").getOrCreate()
    try:
        return _run(args, spark)
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def _show(row) -> None:
    print(f"[{row.ord}] {row.span_id}" + (f"  {' > '.join(row.heading_path)}" if row.heading_path else ""))
    print("\n".join("  " + x for x in wrap_text(row.text, 78)))


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "build":
        done = c.build(spark, args.input, args.out, args.title, args.format)
        print(f"Processed {done.span_count} span(s) → {done.spans_path}")
        return 0
    corpus = c.open_corpus(spark, args.dir)
    if args.command == "search":
        hits = corpus.search(args.query, limit=args.limit, rank=args.rank, fuzzy=FuzzyOptions(enabled=args.fuzzy))
        rows = hits.drop("ord").join(corpus.spans, ["corpus_id", "span_id"]).orderBy("rank").collect()
        print(f"{len(rows)} result(s)")
        for row in rows:
            print(f"{row.score:.4f}", end=" ")
            _show(row)
    elif args.command == "info":
        m = corpus.get_manifest()
        print("\n".join(f"{k}: {m[k]}" for k in ("id", "title", "format", "spanCount", "byteLength", "createdAt")))
    elif args.command in ("span", "order"):
        row = corpus.get_span(args.id) if args.command == "span" else corpus.get_by_order(args.order)
        if row is None:
            print("Span not found", file=sys.stderr)
            return 1
        _show(row)
    elif args.command == "context":
        ids = corpus.neighbors(args.id)
        for row in corpus.spans.filter(corpus.spans.span_id.isin(ids)).orderBy("ord").collect():
            print("→" if row.span_id == args.id else " ", end=" ")
            _show(row)
    elif args.command == "sections":
        for s in corpus.list_sections():
            v = corpus.get_node_map()["sections"][s]
            print(f"{s}  {v['meta']['heading']}  {len(v['paragraphIds'])}: {', '.join(v['paragraphIds'])}")
    else:
        ids = corpus.get_section(args.id)
        if ids is None:
            print("Section not found", file=sys.stderr)
            return 1
        for row in corpus.spans.filter(corpus.spans.span_id.isin(ids)).orderBy("ord").collect():
            _show(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
