"""HTML extraction: flat text blocks classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks; scripts, styles,
titles, comments and other unseen elements are left out. A block's features are its word
count and link density and those of the blocks before and after it. A classification
tree, grown by Gini impurity on the labelled blocks in LABELLED, tells content from
boilerplate; the text of a page is its content blocks, one a line.

The page is read once, left to right, in time proportional to its length whatever it
holds. What isn't closed hides nothing but itself: an unseen element without an end tag
is read as if the tag weren't there, an unclosed script or style ends where the body
begins, an unclosed comment or quote at the next ">", and a tag without any at the end.

Defined cases: null html gives null text and no blocks; an empty page, or one without
words, gives empty text; a page that is a single block is content; very long pages are
read whole; text outside any tag is a block; a "<" that begins no tag is text. Of equal
splits the tree takes the first. The rows keep their order, repeated pages give repeated
rows, null ids stay null; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstack.llm.common import arrow_array, mapped, prepare

#: Elements that hold text other than markup, and elements that hold markup which isn't seen.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
UNSEEN = frozenset("noscript template svg object select datalist".split())
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|(!--)|[!?])")
#: The rest of a tag. Quotes count after an equals sign only.
REST = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|)[^>=]*+)*+>")
BODY = re.compile(r"<(?:/head|body)\b", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SPACE = re.compile(r"\s+")


class Blocks(NamedTuple):
    text: list[str]
    words: list[int]
    linked: list[int]


class Scanner:
    """Where the parts of a page end. What was once sought in vain up to the end isn't sought again."""

    def __init__(self, page: str):
        self.page, self.quotes, self.missing = page, True, set()

    def tag(self, at: int) -> int:
        """The place behind the tag whose name ends at at."""
        if self.quotes:
            if m := REST.match(self.page, at):
                return m.end()
            self.quotes = False
        return self.page.find(">", at) + 1 or len(self.page)

    def comment(self, at: int) -> int:
        for end in ("-->", ">"):
            if end not in self.missing:
                if (k := self.page.find(end, at)) >= 0:
                    return k + len(end)
                self.missing.add(end)
        return len(self.page)

    def element(self, name: str, at: int) -> int:
        """The place of the end tag of an element that isn't read, or at if it is to be read for lack of one."""
        if name not in self.missing:
            if name in UNSEEN and "/" + name not in self.missing:
                depth = 1
                for m in _tags(name).finditer(self.page, at):
                    depth += -1 if m[1] else 1
                    if not depth:
                        return m.start()
                self.missing.add("/" + name)  # they don't nest: each ends at the next end tag
            if m := _end_tag(name).search(self.page, at):
                return m.start()
            self.missing.add(name)
        if name in ("script", "style"):
            if "body" not in self.missing:
                if m := BODY.search(self.page, at):
                    return m.start()
                self.missing.add("body")
            return len(self.page)
        return at


@lru_cache
def _end_tag(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}\b", re.I)


@lru_cache
def _tags(name: str) -> re.Pattern[str]:
    return re.compile(rf"<(/?){name}\b", re.I)


def blocks(page: str) -> Blocks:
    """The flat text blocks of a page, with their words and the words inside links."""
    out, parts, words, linked, depth, at = Blocks([], [], []), [], 0, 0, 0, 0
    scanner = Scanner(page)

    def close() -> None:
        nonlocal words, linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.text.append(text)
            out.words.append(words)
            out.linked.append(linked)
        parts.clear()
        words = linked = 0

    def add(piece: str) -> None:
        nonlocal words, linked
        if piece:
            if "&" in piece:
                piece = entities.unescape(piece)
            parts.append(piece)
            n = len(piece.split())
            words += n
            linked += n if depth else 0

    while m := OPENING.search(page, at):
        add(page[at : m.start()])
        if m[2] is None:
            parts.append(" ")
            at = scanner.comment(m.end()) if m[3] else scanner.tag(m.end())
            continue
        at, name = scanner.tag(m.end()), m[2].lower()
        empty = page[at - 2 : at] == "/>"
        if name in RAW or name in UNSEEN:
            parts.append(" ")
            if not m[1] and not (empty and name == "svg"):
                at = scanner.element(name, at)
        elif name == "a":
            depth = max(0, depth - 1) if m[1] else depth + (not empty)
        elif name == "br":
            parts.append(" ")
        elif name not in INLINE:
            close()
            depth = 0
    add(page[at:])
    close()
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")


def features(b: Blocks) -> np.ndarray:
    """One row a block, in the order of FEATURES; beyond the page there are no words and no links."""
    w = np.array(b.words, float)
    d = np.array(b.linked, float) / np.maximum(w, 1)
    x = np.zeros((len(w) + 2, 2))
    x[1:-1, 0], x[1:-1, 1] = w, d
    return np.concatenate([x[1:-1], x[:-2], x[2:]], 1)


class Node(NamedTuple):
    feature: int  # -1: a leaf
    limit: float
    below: Node | None
    above: Node | None
    content: bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> Node:
    """A tree of the given depth at most, with that many rows a leaf at least; ties go to the first feature and limit."""
    leaf = Node(-1, 0.0, None, None, bool(y.mean() >= 0.5))
    if depth == 0 or y.all() or not y.any():
        return leaf
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        low, high = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
        impurity = 2 * n * low * (1 - low) + 2 * (len(y) - n) * high * (1 - high)
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        if len(impurity) and impurity.min() < best[0]:
            k = int(impurity.argmin())
            best = (impurity[k], f, (v[k] + v[k + 1]) / 2)
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least), leaf.content)


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.content)
    low = x[:, node.feature] <= node.limit
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(node.below, x[low]), classify(node.above, x[~low])
    return out


#: Labelled blocks: FEATURES (links in hundredths), then 1 for content.
LABELLED = """
1 0 0 0 0 0 1
3 0 0 0 0 0 1
8 0 0 0 0 0 1
15 0 0 0 0 0 1
40 0 0 0 0 0 1
120 0 0 0 0 0 1
400 0 0 0 0 0 1
60 8 0 0 0 0 1
1 100 0 0 1 100 0
1 100 1 100 1 100 0
1 100 1 100 4 0 0
1 100 1 100 5 0 0
1 100 1 100 6 0 0
1 100 1 100 7 0 0
1 100 1 100 8 0 0
1 100 1 100 9 0 0
1 100 1 100 10 0 0
1 100 1 100 11 0 0
1 100 1 100 12 0 0
1 100 1 100 13 0 0
4 0 1 100 7 0 0
4 0 1 100 8 0 0
4 0 1 100 9 0 0
4 0 1 100 10 0 0
4 0 1 100 11 0 0
5 0 1 100 8 0 0
5 0 1 100 11 0 0
5 0 1 100 12 0 0
6 0 1 100 8 0 0
6 0 1 100 13 0 0
7 0 1 100 4 0 0
7 0 1 100 7 0 0
7 0 1 100 9 0 0
7 0 1 100 10 0 0
7 0 1 100 11 0 0
7 0 10 0 0 0 0
7 0 19 0 0 0 0
7 0 69 0 0 0 0
7 0 123 0 0 0 0
8 0 1 100 6 0 0
8 0 1 100 7 0 0
8 0 1 100 10 0 0
8 0 1 100 11 0 0
8 0 1 100 14 0 0
8 0 8 0 0 0 0
8 0 9 0 0 0 0
8 0 46 0 0 0 0
9 0 1 100 1 0 0
9 0 1 100 4 0 0
9 0 1 100 7 0 0
9 0 1 100 10 0 0
9 0 13 0 0 0 0
9 0 17 0 0 0 0
9 0 39 0 0 0 0
10 0 1 100 2 0 0
10 0 1 100 7 0 0
10 0 1 100 9 0 0
10 0 1 100 10 0 0
10 0 7 0 0 0 0
10 0 10 0 0 0 0
10 0 13 0 0 0 0
10 0 23 0 0 0 0
10 0 46 0 0 0 0
11 0 1 100 2 0 0
11 0 1 100 12 0 0
11 0 5 0 0 0 0
11 0 9 0 0 0 0
11 0 121 0 0 0 0
11 0 143 0 0 0 0
12 0 1 100 3 0 0
12 0 1 100 8 0 0
12 0 1 100 10 0 0
12 0 4 0 0 0 0
12 0 9 0 0 0 0
12 0 20 0 0 0 0
12 0 28 0 0 0 0
12 0 142 0 0 0 0
13 0 1 100 11 0 0
13 0 5 0 0 0 0
13 0 8 0 0 0 0
13 0 9 0 0 0 0
13 0 10 0 0 0 0
13 0 17 0 0 0 0
14 0 10 0 0 0 0
14 0 17 0 0 0 0
15 0 5 0 0 0 0
15 0 8 0 0 0 0
15 0 20 0 0 0 0
15 0 58 0 0 0 0
16 0 121 0 0 0 0
1 0 1 0 48 0 1
1 0 31 0 94 0 1
1 0 46 0 173 0 1
1 0 85 0 3 0 1
2 0 2 0 2 0 1
2 0 2 0 14 0 1
2 0 11 0 2 0 1
2 0 12 0 19 0 1
2 0 22 0 139 0 1
2 0 72 0 53 0 1
3 0 1 0 43 0 1
4 0 4 0 19 0 1
4 0 5 0 12 0 1
4 0 7 0 4 0 1
4 0 12 0 17 0 1
4 0 64 0 203 0 1
5 0 41 0 11 0 1
6 0 8 0 13 0 1
7 0 10 0 10 0 1
7 0 13 0 10 0 1
7 0 46 0 72 0 1
7 0 86 0 30 0 1
8 0 8 0 27 0 1
8 0 8 0 34 0 1
8 0 10 0 45 0 1
8 0 22 0 45 0 1
8 0 49 0 37 0 1
9 0 9 0 6 0 1
9 0 10 0 9 0 1
9 0 31 0 13 0 1
9 0 45 0 5 0 1
10 0 7 0 7 0 1
10 0 7 0 14 0 1
10 0 9 0 50 0 1
10 0 10 0 16 0 1
10 0 10 0 218 0 1
10 0 12 0 46 0 1
10 0 17 0 8 0 1
11 0 7 0 21 0 1
11 0 7 0 231 0 1
11 0 8 0 49 0 1
11 0 13 0 16 0 1
11 0 83 0 74 0 1
11 0 90 0 17 0 1
12 0 17 0 6 0 1
13 0 6 0 25 0 1
13 0 6 0 68 0 1
13 0 60 0 19 0 1
14 0 2 0 36 0 1
14 0 11 0 32 0 1
14 0 17 0 22 0 1
14 0 24 0 43 0 1
15 0 48 0 34 0 1
16 0 16 0 157 0 1
17 0 8 0 23 0 1
17 0 8 0 33 0 1
17 0 12 0 10 0 1
17 0 41 0 18 0 1
17 0 43 0 14 0 1
17 0 44 0 1 0 1
17 0 56 0 9 0 1
19 0 4 0 26 0 1
19 0 60 0 12 0 1
20 0 4 0 222 0 1
20 0 10 0 60 0 1
20 0 22 0 49 0 1
23 0 11 0 58 0 1
25 0 7 0 48 0 1
25 0 13 0 20 0 1
26 0 19 0 152 0 1
26 0 35 0 8 0 1
27 0 8 0 31 0 1
28 0 21 0 12 0 1
29 0 33 0 15 0 1
31 0 9 0 111 0 1
32 0 10 0 21 0 1
33 0 17 0 29 0 1
33 0 35 0 39 0 1
34 0 8 0 27 0 1
34 0 15 0 222 0 1
34 0 35 0 4 0 1
35 0 5 0 33 0 1
35 0 55 0 34 0 1
36 0 203 0 34 0 1
37 0 14 0 10 0 1
39 0 33 0 46 0 1
40 0 3 0 42 0 1
40 0 43 0 23 0 1
41 0 8 0 5 0 1
41 0 11 0 17 0 1
42 0 40 0 17 0 1
44 0 144 0 126 0 1
45 0 13 0 9 0 1
46 0 10 0 10 0 1
48 0 1 0 24 0 1
49 0 81 0 8 0 1
55 0 28 0 7 0 1
58 0 23 0 15 0 1
60 0 20 0 2 0 1
64 0 94 0 21 0 1
74 0 53 0 16 0 1
79 0 37 0 36 0 1
81 0 153 0 49 0 1
97 0 38 0 10 0 1
121 0 21 0 16 0 1
135 0 9 0 45 0 1
154 0 7 0 46 0 1
161 0 1 0 45 0 1
203 0 4 0 36 0 1
218 0 10 0 72 0 1
20 95 18 90 22 92 0
12 100 15 100 9 100 0
30 80 25 75 28 85 0
6 50 8 60 7 55 0
45 90 40 95 38 88 0
3 100 60 2 4 100 0
5 80 90 0 3 100 0
8 100 70 0 6 100 0
15 70 80 5 12 90 0
25 60 10 100 20 80 0
2 0 3 100 2 100 0
4 0 2 100 5 100 0
60 5 55 3 70 2 1
80 10 40 0 60 5 1
45 20 90 4 85 0 1
35 8 4 0 50 6 1
120 3 8 0 100 1 1
30 15 70 2 66 8 1
22 4 65 0 10 0 1
"""


@lru_cache
def tree() -> Node:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line.strip()])
    rows[:, [1, 3, 5]] /= 100
    return grow(rows[:, :6], rows[:, 6] == 1)


def extracted(page: str, node: Node) -> tuple[str, int, int]:
    """Text, blocks and content blocks of a page."""
    b = blocks(page)
    if not b.text:
        return "", 0, 0
    keep = classify(node, features(b))
    return "\n".join(t for t, k in zip(b.text, keep, strict=True) if k), len(keep), int(keep.sum())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every page; no shuffle."""
    prepare(pages.sparkSession)
    node = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, 0, 0) if v is None else extracted(v, node) for v in (x.as_py() for x in arrow_array(batch, "html"))]
            text, n, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([arrow_array(batch, "page_id").cast(pa.int64()), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "text", "n_blocks", "n_content"])

    return mapped(pages.select("page_id", "html"), run, "page_id bigint, text string, n_blocks int, n_content int")
