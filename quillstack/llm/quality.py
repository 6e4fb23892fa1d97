"""Quality classifier: regularised quadratic discriminant over document statistics.

Two heads share the statistics: one tells good text from junk, one tells toxic
text from the rest. Each class has a shrinkage covariance whose Cholesky factor
is computed once; a score is the difference of the two Mahalanobis log densities
plus the log prior ratio, positive for good (or non-toxic) text. A document is
kept if both scores are positive.

Toxicity needs a vocabulary, which is learned from the labelled rows: whole words
and their first four and five bytes that are far more common in toxic documents.

Defined cases: null and empty texts have the statistics of an empty text; a document
without words is never kept; very long texts are measured whole. Null labels and labels
without an id are ignored, equal labels of a document count once, and labels that
contradict each other count as none. Without both classes of a label that head accepts
everything. Repeated rows get equal scores, a score of 0 is no acceptance, null doc_ids
are scored and filtered like others, an empty table gives none, and other columns,
whatever their names, pass untouched. The models are fitted on the documents of at most
max_labelled labels, drawn by hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm import textvec as tv
from quillstack.llm.common import arrow_array, int_column, keep_masked, mapped, prepare

#: Bound on the labelled documents that a model is fitted on.
MAX_LABELLED = 6000
#: Share of the class covariance replaced by the pooled one, and of the result by a multiple of the identity.
SHRINK_POOLED, SHRINK_IDENTITY = 0.15, 0.05
#: A lexicon entry is at least so many times as common in toxic documents, with this log-likelihood ratio at least.
LEXICON_RATIO, LEXICON_EVIDENCE = 50.0, 16.0

STATS = ("words", "word_length", "upper", "symbols", "digits", "space", "long_words", "distinct", "repeated_lines", "line_length", "top_word", "stops")
PREFIXES = (4, 5)

_CLASS = np.zeros(256, np.uint64)
for _b in range(256):
    _c = chr(_b)
    if "A" <= _c <= "Z":
        _CLASS[_b] = 1
    elif "0" <= _c <= "9":
        _CLASS[_b] = 1 << 32
_SYMBOL = np.zeros(256, np.uint64)
for _c in "#$%&*|!@^~<>{}[]=+\\_/":
    _SYMBOL[ord(_c)] = 1
_SYMBOL[ord("\n")] = 1 << 32


def _sums(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.append(np.uint64(0), np.cumsum(table[data]))
    x = total[off[1:]] - total[off[:-1]]
    return (x & np.uint64(0xFFFFFFFF)).astype(float), (x >> np.uint64(32)).astype(float)


def _per_doc(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, n).astype(float)


def keys_of(w: tv.Words, kinds: tuple[int, ...] = (0, *PREFIXES)) -> list[np.ndarray]:
    """Hashes of each word (0) and of its first bytes."""
    prefix = tv.prefix_hash(w.data)
    return [w.hash if k == 0 else tv.span_hash(prefix, w.start, np.minimum(w.start + k, w.end)) + np.uint64(k) for k in kinds]


def statistics(text: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """One row a document: the transformed STATS, then two for the lexicon."""
    raw, off = tv.buffers(text)
    w = tv.words(text)
    n, doc, count = len(off) - 1, w.doc, np.diff(w.first).astype(float)
    size = np.diff(off).astype(float)
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    upper, digit = _sums(_CLASS, raw, off)
    symbol, lines = _sums(_SYMBOL, raw, off)
    length = (w.end - w.start).astype(float)
    total = _per_doc(doc, n, length)

    def top(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and the most occurrences of one, by document."""
        x = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
        at = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, int)
        most = np.zeros(n)
        owner = (x[at[:-1]] >> np.uint64(44)).astype(int)
        np.maximum.at(most, owner, np.diff(at))
        return _per_doc(owner, n), most

    distinct, most = top(doc, w.hash)
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.append(off[:-1][size > 0], breaks + 1))
    end = np.sort(np.append(off[1:][size > 0], breaks))
    good = end > start
    start, end = start[good], end[good]
    line_doc = np.searchsorted(off, start, "right") - 1
    different, _ = top(line_doc, tv.span_hash(tv.prefix_hash(raw), start, end)) if len(start) else (np.zeros(n), None)
    short = _per_doc(doc, n, length <= 3)
    rate = lambda x, of: np.log((x + 0.5) / (of + 1.0))
    hits = np.zeros(n)
    if len(lexicon):
        found = np.zeros(len(doc), bool)
        for key in keys_of(w):
            at = np.minimum(np.searchsorted(lexicon, key), len(lexicon) - 1)
            found |= lexicon[at] == key
        hits = _per_doc(doc, n, found)
    return np.stack(
        [
            np.log1p(count), np.log((total + 1) / some), rate(upper, chars), rate(symbol, chars), rate(digit, chars), np.log((chars - total + 1) / some),
            rate(_per_doc(doc, n, length > 12), some), rate(distinct, some) + 0.25 * np.log1p(count), rate(_per_doc(line_doc, n) - different, _per_doc(line_doc, n)),
            np.log(chars / (lines + 1)), rate(most, some), rate(short, some), np.log1p(hits), rate(hits, some),
        ],
        1,
    )


class Gaussian(NamedTuple):
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor
    log_norm: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_norm - 0.5 * (z * z).sum(1)


class Head(NamedTuple):
    """Score of the first class over the second; columns are the statistics it uses."""

    columns: tuple[int, ...]
    centre: np.ndarray
    scale: np.ndarray
    good: Gaussian
    bad: Gaussian
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        x = (stats[:, self.columns] - self.centre) / self.scale
        return self.good.log_density(x) - self.bad.log_density(x) + self.prior


class Model(NamedTuple):
    lexicon: np.ndarray
    quality: Head | None
    toxic: Head | None

    def scores(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality score, clean-of-toxicity score, and whether to keep."""
        stats = statistics(text, self.lexicon)
        q, t = (h.score(stats) if h else np.ones(len(stats)) for h in (self.quality, self.toxic))
        return q, t, (q > 0) & (t > 0) & (stats[:, 0] > 0)


def fit_head(stats: np.ndarray, good: np.ndarray, columns: tuple[int, ...]) -> Head | None:
    """None unless both classes have two rows."""
    if min(good.sum(), (~good).sum()) < 2:
        return None
    x = stats[:, columns]
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - centre) / scale
    pooled = sum(np.cov(x[g].T, bias=True).reshape(x.shape[1], -1) * g.mean() for g in (good, ~good))

    def gaussian(rows: np.ndarray) -> Gaussian:
        p = rows.shape[1]
        cov = (1 - SHRINK_POOLED) * np.cov(rows.T, bias=True).reshape(p, p) + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_IDENTITY) * cov + SHRINK_IDENTITY * max(np.trace(cov) / p, 1e-3) * np.eye(p)
        low = np.linalg.cholesky(cov)
        return Gaussian(rows.mean(0), np.linalg.inv(low), -float(np.log(np.diag(low)).sum()))

    return Head(columns, centre, scale, gaussian(x[good]), gaussian(x[~good]), float(np.log(good.sum() / (~good).sum())))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit both heads on the labelled rows of docs; two passes over those rows only."""
    spark = docs.sparkSession
    prepare(spark)
    chosen = labels.select("doc_id", "quality", "toxic").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(max_labelled)
    said: dict[int, tuple[set[int], set[int]]] = {}
    for i, *given in chosen.collect():
        for seen, x in zip(said.setdefault(i, (set(), set())), given, strict=True):
            if x is not None:
                seen.add(int(x))
    by_id = {i: tuple(next(iter(seen)) if len(seen) == 1 else -1 for seen in pair) for i, pair in said.items()}
    if not by_id:
        return Model(np.zeros(0, np.uint64), None, None)
    sample = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame([(i,) for i in by_id], "doc_id bigint")), "doc_id", "left_semi")
    lab = spark.sparkContext.broadcast(by_id)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                toxic = np.array([lab.value[i][1] for i in int_column(part, "doc_id")])
                w = tv.words(arrow_array(part, "text"))
                doc = w.doc
                seen = []
                for key in keys_of(w):
                    pair = np.unique(np.stack([key, doc.astype(np.uint64)], 1), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
                    seen.append(pair)
                pair = np.concatenate(seen)
                t = toxic[pair[:, 1].astype(int)]
                key, at = np.unique(pair[:, 0], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, t == 1, len(key)).astype(np.int64)), pa.array(np.bincount(at, t == 0, len(key)).astype(np.int64))], names=["key", "bad", "rest"])

    n_bad, n_rest = (sum(t == k for _, t in by_id.values()) for k in (1, 0))
    lexicon = np.zeros(0, np.uint64)
    if n_bad and n_rest:
        counts = mapped(sample, count, "key bigint, bad bigint, rest bigint").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("rest").alias("rest"))
        bad, rest, share = F.col("bad"), F.col("rest"), n_bad / (n_bad + n_rest)
        part = lambda n, p: F.when(n > 0, n * F.log(n / ((bad + rest) * p))).otherwise(0.0)
        picked = counts.filter((bad / n_bad >= LEXICON_RATIO * (rest + 0.5) / n_rest) & (2 * (part(bad, share) + part(rest, 1 - share)) >= LEXICON_EVIDENCE))
        lexicon = np.sort(picked.select("key").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))

    lab.destroy()
    lex = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                stats = statistics(arrow_array(part, "text"), lex.value)
                yield pa.RecordBatch.from_arrays([arrow_array(part, "doc_id").cast(pa.int64()), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    table = mapped(sample, measure, "doc_id bigint, stats array<double>").toArrow().sort_by("doc_id")
    lex.destroy()
    if not table.num_rows:
        return Model(lexicon, None, None)
    stats = np.array(table.column("stats").to_pylist())
    quality, toxic = np.array([by_id[i] for i in table.column("doc_id").to_pylist()]).T
    k, n = len(STATS), stats.shape[1]
    return Model(
        lexicon,
        fit_head(stats[quality >= 0], quality[quality >= 0] == 1, tuple(range(k))),
        fit_head(stats[toxic >= 0], toxic[toxic >= 0] == 0, tuple(range(k, n))) if len(lexicon) else None,
    )


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, toxic_score, keep) of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                q, t, keep = model.value.scores(arrow_array(part, "text"))
                yield pa.RecordBatch.from_arrays([arrow_array(part, "doc_id").cast(pa.int64()), pa.array(q), pa.array(t), pa.array(keep)], names=["doc_id", "score", "toxic_score", "keep"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, score double, toxic_score double, keep boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that are kept, all columns as they were; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        parts = [model.value.scores(arrow_array(p, "text"))[2] for p in tv.chunks(batch, "text")]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    return keep_masked(docs, mask)
