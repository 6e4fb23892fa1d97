"""Substring dedup by suffix automata of reference shards.

A span of words of a document is removed if it is at least MIN_WORDS long and occurs
in a document with a smaller doc_id; the first occurrence stays. To be exact: a word
goes if a window of MIN_WORDS words around it occurs in such a document.

Only text that can repeat meets an automaton. Winnowing picks word k-grams such that
every window of MIN_WORDS words holds one, chosen by the window's content alone; equal
windows thus share a picked k-gram, and k-grams picked in a single document are dropped.
Those of a k-gram that is left belong to the least document having it, their reference
shard. Equal texts around them are collapsed before they are sent: only the least
document's goes to the shard, the others are repeats as they stand. In the shard each text
is streamed, in order of doc_id, through the shard's suffix automaton, whose matching
statistics give the maximal spans that earlier documents hold; what was new is added.

A shard is bounded: one of more than SHARD_BYTES of different texts, as thousands of edited
copies of a document make, takes another way, in which no task holds it. Every window's
least document is found by a grouped minimum, which gives the same words. Automata stay with
the task of their shard; the README says why they aren't broadcast.

Defined cases: texts without words, empty and null texts stay as they are; a document whose
words all go has empty text; very long texts are read whole; rows with the same doc_id don't
count as earlier for each other, and repeated rows lose the same words; rows with null doc_id
neither are cut nor count; there are no ties, as ids are compared; an empty table gives none;
other columns, whatever their names, are not read. Words compare in lower case and without
what stands between them. A removed span goes from its first word to the end of its last.
Repeats within one document stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm import textvec as tv
from quillstack.llm.common import BROADCAST_BYTES, HOT_ROWS, SAMPLED, Run, arrow_array, collected, drop, grouped, hot_keys, inside, int_column, list_rows, mapped, matching, prepare, run_starts, written

MIN_WORDS, GRAM = 50, 25
#: Bytes of the different texts of a shard that an automaton takes, 4 a word.
SHARD_BYTES = 1 << 19


def picked(w: tv.Words, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (index of its first word) and hash of the k-grams that winnowing picks."""
    width = min_words - gram + 1  # k-grams in a window
    count = len(w.hash) - gram + 1
    if count < width:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    prefix = tv.prefix_hash(w.hash)
    start = np.arange(count)
    h = tv.span_hash(prefix, start, start + gram)
    doc = w.doc
    low = tv.sliding(h, width, np.minimum)
    low[doc[: len(low)] != doc[min_words - 1 :]] = 0  # no window crosses documents; hashes of 0 would be missed
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == tv.sliding(np.concatenate([pad, low, pad]), width, np.maximum))
    return at, h[at]


def row_hashes(w: tv.Words) -> np.ndarray:
    """31 bits of the words of each document, which tell rows of the same doc_id apart."""
    return (tv.span_hash(tv.prefix_hash(w.hash), w.first[:-1], w.first[1:]) >> np.uint64(33)).astype(np.int32)


PRINT = "f bigint, doc_id bigint, row int, pos int"
PLACE = "shard bigint, doc_id bigint, row int, pos int"


def _fingerprints(min_words: int, gram: int, pick: Callable[[np.ndarray], np.ndarray] | None = None) -> Run:
    """For mapInArrow over documents: (f, doc_id, row, pos) of the picked k-grams whose hash f is picked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                w = tv.words(arrow_array(part, "text"))
                at, h = picked(w, min_words, gram)
                doc, h = w.doc[at], h.view(np.int64)
                ok = arrow_array(part, "doc_id").is_valid().to_numpy(zero_copy_only=False)[doc]
                if pick is not None:
                    ok &= pick(h)
                at, h, doc = at[ok], h[ok], doc[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(int_column(part, "doc_id")[doc]), pa.array(row_hashes(w)[doc]), pa.array((at - w.first[doc]).astype(np.int32))], names=["f", "doc_id", "row", "pos"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (f, doc_id, row, pos) sorted by f, doc_id: (shard, doc_id, row, pos) of each f that two documents have."""
    for table in grouped(batches, ["f"]):
        f, doc, row, pos = (table.column(c).to_numpy() for c in ("f", "doc_id", "row", "pos"))
        at = run_starts(f)
        own = np.repeat(doc[at[:-1]], np.diff(at))
        several = np.repeat(doc[at[:-1]] != doc[at[1:] - 1], np.diff(at))
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (own, doc, row, pos)], names=["shard", "doc_id", "row", "pos"])


def _owned(f: np.ndarray, owner: np.ndarray) -> Run:
    """For mapInArrow over (f, doc_id, row, pos) whose f are all known: (shard, doc_id, row, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = owner[np.searchsorted(f, int_column(batch, "f"))]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(arrow_array(batch, c) for c in ("doc_id", "row", "pos"))], names=["shard", "doc_id", "row", "pos"])

    return run


def _regions(before: int, after: int) -> Run:
    """For mapInArrow over (shard, doc_id, row, pos) sorted by doc_id, row, shard, pos: (doc_id, row, shard, low, high),
    the word ranges from before to after the places, those that meet as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["doc_id"]):
            doc, row, shard, pos = (table.column(c).to_numpy() for c in ("doc_id", "row", "shard", "pos"))
            low, high = np.maximum(pos - before, 0), pos + after
            new = np.ones(len(pos), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], row[first], shard[first], low[first].astype(np.int32), high[last].astype(np.int32))], names=["doc_id", "row", "shard", "low", "high"])

    return run


REGION = "doc_id bigint, row int, shard bigint, low int, high int"
STRETCH = "shard bigint, c1 bigint, c2 bigint, doc_id bigint, row int, start int, n int, words binary"


def _stretches(min_words: int, regions_of) -> Run:
    """For mapInArrow over documents: the text in the regions, with a hash (c1, c2) of shard and words;
    regions_of(part) gives (place in part, row, shard, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                doc, row, shard, low, high = regions_of(part)
                if not len(doc):
                    continue
                w = tv.words(arrow_array(part, "text"))
                high = np.minimum(high, np.diff(w.first)[doc])
                ok = (row == row_hashes(w)[doc]) & (high - low >= min_words)
                doc, row, shard, low, high = (x[ok] for x in (doc, row, shard, low, high))
                words = (w.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
                base, ids = w.first[doc], int_column(part, "doc_id")[doc]
                prefix = [tv.prefix_hash(h) for h in (w.hash, tv.mix(w.hash))]
                c1, c2 = (tv.mix(tv.span_hash(p, base + low, base + high) ^ tv.mix(shard.view(np.uint64))).view(np.int64) for p in prefix)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (shard, c1, c2, ids, row, low.astype(np.int32), (high - low).astype(np.int32))), pa.array([words[b + s : b + e].tobytes() for b, s, e in zip(base, low, high, strict=True)], pa.binary())],
                    names=["shard", "c1", "c2", "doc_id", "row", "start", "n", "words"],
                )

    return run


class Automaton:
    """Suffix automaton of several word sequences; a separator that occurs nowhere else parts them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.parts = 0, 0

    def add(self, words: list[int]) -> None:
        self.parts += 1
        for c in (*words, (1 << 40) + self.parts):
            self._extend(c)

    def _extend(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def statistics(self, words: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = have = 0
        out = []
        for c in words:
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                have = length[v]
                t = nxt[v].get(c)
            if t is not None:
                v, have = t, have + 1
            else:
                have = 0
            out.append(have)
        return out


SPAN = "c1 bigint, c2 bigint, low int, high int"


def _matched(min_words: int) -> Run:
    """For mapInArrow over (shard, doc_id, c1, c2, words) sorted so, each text of a shard once and at its least document:
    (c1, c2, low, high), the spans of the text that documents before hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["shard"]):
            out: list[tuple[int, int, int, int]] = []
            shard = doc = None
            fresh: list[list[int]] = []
            for batch in table.to_batches():
                raws = arrow_array(batch, "words")
                for i, (s, d, c1, c2) in enumerate(zip(*(arrow_array(batch, c).to_pylist() for c in ("shard", "doc_id", "c1", "c2")), strict=True)):
                    if s != shard:
                        shard, doc, auto, fresh = s, d, Automaton(), []
                    elif d != doc:
                        for x in fresh:
                            auto.add(x)
                        doc, fresh = d, []
                    words = np.frombuffer(raws[i].as_buffer(), np.int32).tolist()
                    stats = auto.statistics(words) if auto.parts else [0] * len(words)
                    # overlapping matches are one span; what no match of min_words holds is new to the automaton
                    span = new_from = None
                    for k, have in enumerate(stats):
                        if have >= min_words:
                            if span is not None and k + 1 - have <= span[1]:
                                span[1] = k + 1
                            else:
                                if span is not None:
                                    out.append((c1, c2, *span))
                                span = [k + 1 - have, k + 1]
                            if new_from is not None:
                                fresh.append(words[new_from:k])
                                new_from = None
                        elif k + 1 >= min_words and new_from is None:
                            new_from = k + 1 - min_words
                    if span is not None:
                        out.append((c1, c2, *span))
                    if new_from is not None:
                        fresh.append(words[new_from:])
            if out:
                a = np.array(out, np.int64).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(a[2].astype(np.int32)), pa.array(a[3].astype(np.int32))], names=["c1", "c2", "low", "high"])

    return run


def _windows(min_words: int) -> Run:
    """For mapInArrow over (shard, doc_id, c1, c2, words): (h, doc_id, c1, c2, pos) of every window of min_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = arrow_array(batch, "words")
            columns = [int_column(batch, c) for c in ("shard", "doc_id", "c1", "c2")]
            for i in range(batch.num_rows):
                words = np.frombuffer(raws[i].as_buffer(), np.uint32).astype(np.uint64)
                at = np.arange(len(words) - min_words + 1)
                shard, *rest = (int(c[i]) for c in columns)
                h = tv.mix(tv.span_hash(tv.prefix_hash(words), at, at + min_words) ^ tv.mix(np.array([shard]).view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.full(len(at), x)) for x in rest), pa.array(at.astype(np.int32))], names=["h", "doc_id", "c1", "c2", "pos"])

    return run


def _joined(min_words: int) -> Run:
    """For mapInArrow over (c1, c2, pos) sorted so: (c1, c2, low, high), the windows that overlap as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["c1", "c2"]):
            c1, c2, pos = (table.column(c).to_numpy() for c in ("c1", "c2", "pos"))
            new = np.ones(len(pos), bool)
            new[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (pos[1:] > pos[:-1] + min_words)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c1[first], c2[first], pos[first], pos[last] + np.int32(min_words))], names=["c1", "c2", "low", "high"])

    return run


def places(docs: DataFrame, min_words: int, gram: int, hot_rows: int) -> DataFrame:
    """(shard, doc_id, row, pos) of the picked k-grams that two documents have; the shard is the least of them.
    A k-gram that very many documents have finds its shard by a grouped minimum, and its rows stay where they are."""
    schema = PRINT
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    hot = hot_keys(mapped(some, _fingerprints(min_words, gram), schema).select(F.col("f").alias("key")), max(1, hot_rows // SAMPLED))
    prints = mapped(docs, _fingerprints(min_words, gram, (lambda f: ~inside(hot, f)) if len(hot) else None), schema)
    out = mapped(prints.repartition("f").sortWithinPartitions("f", "doc_id"), _shared, PLACE)
    if len(hot):
        common = mapped(docs, _fingerprints(min_words, gram, lambda f: inside(hot, f)), schema)
        least = common.groupBy("f").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last")).filter("own < last").toArrow().sort_by("f")
        f, own = (least.column(c).to_numpy() for c in ("f", "own"))
        out = out.union(mapped(mapped(docs, _fingerprints(min_words, gram, lambda x: inside(f, x)), schema), _owned(f, own), PLACE))
    return out


def spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, limit: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, row, start, end): word spans that an earlier document holds, possibly overlapping."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    reach = min_words - gram
    regions = written(mapped(places(docs, min_words, gram, hot_rows).repartition("doc_id").sortWithinPartitions("doc_id", "row", "shard", "pos"), _regions(reach, gram + reach), REGION))
    names = ("row", "shard", "low", "high")
    rows = collected(regions, 28, limit)
    if rows is not None:  # few regions: the texts stay where they are
        ids = rows.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        sent = docs.sparkSession.sparkContext.broadcast((ids[order], *(rows.column(c).to_numpy()[order] for c in names)))

        def from_broadcast(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            all_ids, *columns = sent.value
            at_row, at = matching(all_ids, int_column(part, "doc_id"))
            return at_row, *(x[at] for x in columns)

        pieces = mapped(docs, _stretches(min_words, from_broadcast), STRETCH)
    else:
        per_doc = regions.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(*names)).alias("regions"))

        def from_column(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            at_row, flat = list_rows(arrow_array(part, "regions"))
            return at_row, *(flat.field(i).to_numpy() for i in range(4))

        pieces = mapped(docs.join(per_doc, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "regions"), _stretches(min_words, from_column), STRETCH)
    pieces = written(pieces)
    # equal texts of a shard count once, at the least document that has them; elsewhere they are repeats as they stand
    text = ["c1", "c2"]
    least = written(pieces.groupBy(*text, "shard").agg(F.min("doc_id").alias("first"), F.any_value("words").alias("words")))
    distinct = least.select("shard", F.col("first").alias("doc_id"), *text, "words")
    large = written(distinct.groupBy("shard").agg(F.sum(F.length("words")).alias("bytes")).filter(F.col("bytes") > shard_bytes).select("shard"))
    small = distinct.join(large, "shard", "left_anti") if (any_large := not large.isEmpty()) else distinct
    inner = mapped(small.select("shard", "doc_id", *text, "words").repartition("shard").sortWithinPartitions("shard", "doc_id", *text), _matched(min_words), SPAN)
    if any_large:  # no task takes such a shard whole: each window looks for the least document that has it
        windows = written(mapped(distinct.join(large, "shard", "left_semi").select("shard", "doc_id", *text, "words"), _windows(min_words), "h bigint, doc_id bigint, c1 bigint, c2 bigint, pos int"))
        owner = windows.groupBy("h").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last")).filter("own < last").select("h", "own")
        late = windows.join(owner, "h").filter("doc_id <> own").select(*text, "pos")
        inner = inner.union(mapped(late.repartition(*text).sortWithinPartitions(*text, "pos"), _joined(min_words), SPAN))
    inner = written(inner)
    held = pieces.drop("words", "shard").join(least.select(*text, "first"), text)
    whole = held.filter("doc_id <> first").select("doc_id", "row", "start", (F.col("start") + F.col("n")).alias("end"))
    part = held.filter("doc_id = first").join(inner, text).select("doc_id", "row", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))
    return whole.union(part)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, limit: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text, n_removed): every row's text without its repeated spans, and how many words went."""
    found = written(spans(docs, min_words, gram, limit, shard_bytes, hot_rows))
    docs, schema = docs.select("doc_id", "text"), "doc_id bigint, text string, n_removed int"
    names = ("row", "start", "end")
    rows = collected(found, 20, limit)
    if rows is not None:
        ids = rows.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        sent = docs.sparkSession.sparkContext.broadcast((ids[order], *(rows.column(c).to_numpy()[order] for c in names)))
        drop(found)

        def from_broadcast(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            all_ids, *columns = sent.value
            row, at = matching(all_ids, int_column(batch, "doc_id"))
            return row, *(x[at] for x in columns)

        return mapped(docs, _removed(from_broadcast), schema)
    cut = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(*names)).alias("cut"))

    def from_column(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        row, flat = list_rows(arrow_array(batch, "cut"))
        return row, *(flat.field(i).to_numpy() for i in range(3))

    return mapped(docs.join(cut, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "cut"), _removed(from_column), schema)


def _removed(spans_of) -> Run:
    """For mapInArrow over documents: (doc_id, text, n_removed); spans_of(batch) gives (place, row, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = arrow_array(batch, "text")
            place, row, lo, hi = spans_of(batch)
            gone = np.zeros(batch.num_rows, np.int32)
            new: dict[int, str] = {}
            at = run_starts(place)
            for s, e in zip(at[:-1], at[1:], strict=True):
                i = int(place[s])
                if not text[i].is_valid:
                    continue
                one = text.slice(i, 1)
                mine = row[s:e] == row_hashes(tv.words(one))[0]
                if mine.any():
                    new[i], gone[i] = without_words(one, lo[s:e][mine], hi[s:e][mine])
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                text = pa.compute.replace_with_mask(text, pa.array(mask), pa.array([new[i] for i in sorted(new)], text.type))
            yield pa.RecordBatch.from_arrays([arrow_array(batch, "doc_id").cast(pa.int64()), text, pa.array(gone)], names=["doc_id", "text", "n_removed"])

    return run


def without_words(text: pa.Array, lo: np.ndarray, hi: np.ndarray) -> tuple[str, int]:
    """A text without its words in the spans [lo, hi), and the number of these words."""
    raw, _, start, end = tv.original_bounds(text)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, np.minimum(lo, len(start)), 1)
    np.add.at(edge, np.minimum(hi, len(start)), -1)
    drop = np.cumsum(edge[:-1]) > 0
    if not len(drop) or drop.all():
        return "" if len(drop) else raw.tobytes().decode(), len(drop)
    pieces, last = [], 0
    at = run_starts(drop)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if drop[s]:
            pieces.append(raw[last : start[s]].tobytes())
            last = end[e - 1]
    return b"".join([*pieces, raw[last:].tobytes()]).decode(), int(drop.sum())
