"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The frequency of every benchmark word is counted over the whole corpus. A word
trigram of a test item is a seed if, were words independent, it would be expected
at most SEED_RATE times per position; an item with fewer than MIN_SEEDS seeds
takes its MIN_SEEDS rarest trigrams as well. How often a seed itself occurs doesn't
matter, so an item that leaked many times keeps its seeds. Items of one or two words
have one seed, all their words, sought among the documents' words and pairs of words.

Each occurrence of a seed in a document proposes a diagonal; the words around it are
aligned with the item (match 1, mismatch and gap -0.5). The score is the best local
alignment over the item's number of words; at least THRESHOLD is a leak.

Test items travel to the workers in blocks of bounded size; a larger benchmark takes
several passes. Defined cases: null, empty or wordless texts and items match nothing;
very long texts are searched whole; items with the same text are each reported; rows
with the same doc_id, repeated rows among them, report the best score of any of them;
null doc_ids can't be reported and are kept only if clean; an item without an id counts
for nothing; empty tables give no leaks and drop nothing; other columns, whatever their
names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm import textvec as tv
from quillstack.llm.common import BROADCAST_BYTES, arrow_array, drop, int_column, keep_masked, mapped, prepare, run_starts, written

SEED, SEED_RATE, MIN_SEEDS, THRESHOLD = 3, 3e-8, 8, 0.5
MISMATCH = GAP = 0.5
#: Words around the item's place that are aligned too, as a share of its length and at least.
SLACK_SHARE, SLACK = 0.25, 8
#: Bytes that an item's word takes in a block, seeds included.
WORD_BYTES = 48


class Items(NamedTuple):
    ids: np.ndarray
    first: np.ndarray  # of each item's words
    words: np.ndarray
    seeds: np.ndarray  # sorted hashes, with the item and the place in it
    seed_item: np.ndarray
    seed_at: np.ndarray
    filter: np.ndarray  # a bitmap of the seeds' low bits
    short: tuple[int, ...]  # numbers of words, less than SEED, that items have


def _counts(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                h = tv.words(arrow_array(part, "text")).hash
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                count += np.bincount(at[words[at] == h], minlength=len(words))
                total += len(h)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[some], total))], names=["word", "n"])

    return run


def blocks(docs: DataFrame, items: DataFrame, block_bytes: int = BROADCAST_BYTES) -> list[Items]:
    """The benchmark with its seeds, in blocks that may be broadcast; reads it block by block."""
    prepare(docs.sparkSession)
    rows = written(items.select("item_id", "text").filter("item_id is not null and text is not null"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size * WORD_BYTES // 4 // block_bytes))
    out = []
    for b in range(n_blocks):
        table = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).dropDuplicates().toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        w = tv.words(table.column("text"))
        if not len(w.hash):
            continue
        vocabulary, word = np.unique(w.hash, return_inverse=True)
        found = mapped(docs.select("text"), _counts(vocabulary), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        count = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
        total = max(1, count.pop(-1, 1))
        log_rate = np.log((np.array([count.get(i, 0) for i in range(len(vocabulary))]) + 0.5) / total)
        hashes, doc = tv.shingles(w, SEED)
        at = np.arange(len(doc)) - np.searchsorted(doc, doc)
        start = w.first[doc] + at
        prefix = np.append(0.0, np.cumsum(log_rate[word]))
        rate = prefix[start + np.minimum(SEED, np.diff(w.first)[doc])] - prefix[start]
        order = np.lexsort((rate, doc))
        rank = np.empty(len(doc), int)
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc, doc[order])
        use = np.flatnonzero((rate <= np.log(SEED_RATE)) | (rank < MIN_SEEDS))
        use = use[np.argsort(hashes[use], kind="stable")]
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(hashes[use] & np.uint64((1 << 20) - 1)).astype(int)] = True
        short = tuple(k for k in range(1, SEED) if (np.diff(w.first) == k).any())
        out.append(Items(table.column("item_id").to_numpy().astype(np.int64), w.first, w.hash, hashes[use], doc[use], at[use], bitmap, short))
    drop(rows)
    return out


def _seen(w: tv.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place among all words of every run of n words of a document."""
    prefix = tv.prefix_hash(w.hash)
    start = np.arange(max(0, len(w.hash) - n + 1))
    start = start[w.doc[start] == w.doc[start + n - 1]]
    return tv.span_hash(prefix, start, start + n), start


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of a with the same row of b. Padding must not match."""
    n, width = b.shape
    ramp = np.arange(width + 1) * np.float32(GAP)
    row = np.zeros((n, width + 1), np.float32)
    best = np.zeros(n, np.float32)
    for i in range(a.shape[1]):
        same = np.where(b == a[:, i : i + 1], np.float32(1), np.float32(-MISMATCH))
        x = np.maximum(row - np.float32(GAP), 0)
        x[:, 0] = 0
        np.maximum(x[:, 1:], row[:, :-1] + same, out=x[:, 1:])
        row = np.maximum.accumulate(x + ramp, 1) - ramp
        np.maximum(best, row.max(1), out=best)
    return best


def _padded(values: np.ndarray, start: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    size = end - start
    out = np.full((len(start), int(size.max())), np.uint64(pad))
    row = np.repeat(np.arange(len(start)), size)
    col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = values[start[row] + col]
    return out


def leaks_in(text: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of every proposed pair."""
    w = tv.words(text)
    hashes, start = (np.concatenate(x) for x in zip(*(_seen(w, n) for n in (*items.short, SEED)), strict=True))
    near = np.flatnonzero(items.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    lo = np.searchsorted(items.seeds, hashes[near])
    hi = np.searchsorted(items.seeds, hashes[near], "right")
    size = hi - lo
    if not size.sum():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
    hit = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
    place = start[np.repeat(near, size)]
    own, item = w.doc[place], items.seed_item[hit]
    diagonal = place - w.first[own] - items.seed_at[hit]
    length = np.diff(items.first)
    slack = np.maximum(SLACK, (length * SLACK_SHARE).astype(int))
    order = np.lexsort((diagonal, item, own))
    own, item, diagonal = own[order], item[order], diagonal[order]
    # diagonals within half the slack of the first of their run share a window
    cell = diagonal // np.maximum(1, slack[item] // 2)
    at = run_starts(own, item, cell)[:-1]
    own, item, low, high = own[at], item[at], np.minimum.reduceat(diagonal, at), np.maximum.reduceat(diagonal, at)
    start = np.clip(low - slack[item], 0, None) + w.first[own]
    end = np.minimum(high + length[item] + slack[item] + w.first[own], w.first[own + 1])
    score = np.zeros(len(own), np.float32)
    order = np.argsort(length[item], kind="stable")
    for k in range(0, len(order), 256):
        part = order[k : k + 256]
        i = item[part]
        score[part] = align(_padded(items.words, items.first[i], items.first[i + 1], 1), _padded(w.hash, start[part], end[part], 2)) / length[i]
    return own, item, score


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, score) of every document and test item that align."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double"
    out = spark.createDataFrame([], schema)
    for block in blocks(docs, items, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tv.chunks(batch, "text"):
                    doc, item, score = leaks_in(arrow_array(part, "text"), sent.value)
                    ok = (score >= threshold) & arrow_array(part, "doc_id").is_valid().to_numpy(zero_copy_only=False)[doc]
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(int_column(part, "doc_id")[doc[ok]]), pa.array(sent.value.ids[item[ok]]), pa.array(score[ok].astype(float))], names=["doc_id", "item_id", "score"])

        out = out.union(mapped(docs.select("doc_id", "text"), run, schema))
    return out.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs in which no test item leaks, all columns as they were; no shuffle of texts."""
    for block in blocks(docs, items, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def mask(batch: pa.RecordBatch, sent=sent) -> np.ndarray:
            keep, base = np.ones(batch.num_rows, bool), 0
            for part in tv.chunks(batch, "text"):
                doc, _, score = leaks_in(arrow_array(part, "text"), sent.value)
                keep[base + doc[score >= threshold]] = False
                base += part.num_rows
            return keep

        docs = keep_masked(docs, mask)
    return docs
