"""LM scoring: a gated recurrent language model with a class-factored softmax.

The vocabulary is counted over all documents: the most frequent words that make up
COVERAGE of all words' occurrences, at least VOCABULARY of them, and all words as
frequent as the last; it grows with the corpus. Other words are predicted as an unknown
word and spelled by the corpus's byte pairs; read, they are told apart by a hash into as
many inputs as there are words. Words fall into classes that hold equal shares of the
square roots of the frequencies, and a word's probability is that of its class times that
of the word within its class, both read from the state of a gated recurrent unit, which
reads a vector for each input.

Training is data parallel. All documents, each once, are split by hash of doc_id
into rounds and shards whose number grows with the corpus, as far as a shard has
WORDS_A_PARAMETER for every parameter that it sends; each shard runs truncated
backpropagation from the round's common parameters, the state carried from window to
window within a document, or a stretch of STRETCH words of a longer one, and the results are averaged, weighted by words. Scoring
runs every document whole, window after window with the state carried, to the end
symbol; its log-likelihood is complete.

Defined cases: null and empty texts have the probability of the end symbol alone; very
long texts are scored and trained on whole; rows are scored one by one, so repeated rows
repeat; null doc_ids are scored but not trained on; words tied in frequency are ranked by
hash; an empty table gives no rows; with no document to train on the model is the
frequencies that it starts from; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm import textvec as tv
from quillstack.llm.common import arrow_array, drop, mapped, prepare, written

COVERAGE, VOCABULARY, HIDDEN = 0.9, 2048, 24
ROUNDS, SHARD_DOCUMENTS, WORDS_A_PARAMETER = 3, 1000, 0.5
STREAMS, WINDOW, STRETCH, RATE, CLIP = 256, 16, 1024, 0.08, 5.0
#: Fewer streams are used where there would be fewer steps of training.
LEAST_STEPS = 64
SCORE_STREAMS, SCORE_WORDS = 512, 1 << 21
BLOCKS = 64
#: exp() of it fits float32 many times over; no trained logit comes near it.
MOST_LOGIT = np.float32(60)
#: Powers of classes that are computed together, few enough to stay in a core's cache.
OUTPUTS = 1 << 17
#: Of the gates z and r half is taken: a sigmoid is half a hyperbolic tangent of half.
HALF = np.array([0.5, 0.5, 1], np.float32)[:, None]


class Vocabulary(NamedTuple):
    words: np.ndarray  # sorted hashes
    ids: np.ndarray  # rank of each by count, the unknown word and the end ranked with them
    counts: np.ndarray  # by rank
    unknown: int
    end: int
    spelling: np.ndarray  # log-probability of a byte after another; row 256 before the first, column 256 the word's end

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def inputs(self) -> int:
        """Symbols that may be read: words by rank, unknown words by hash, the start of a document last."""
        return 2 * self.size + 1

    def encode(self, w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words as read and as predicted, and the log-probability of each unknown word's spelling (0 for known ones)."""
        at = np.minimum(np.searchsorted(self.words, w.hash), max(len(self.words) - 1, 0))
        known = self.words[at] == w.hash if len(self.words) else np.zeros(len(w.hash), bool)
        ids = np.where(known, self.ids[at] if len(self.ids) else self.unknown, self.unknown).astype(np.int32)
        read = np.where(known, ids, self.size + (w.hash % np.uint64(self.size)).astype(np.int32))
        new = np.flatnonzero(~known)
        start, size = w.start[new], (w.end - w.start)[new]
        step = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        byte = w.data[step].astype(np.int64)
        before = np.append(256, byte[:-1])
        before[np.cumsum(size) - size] = 256
        total = np.append(0.0, np.cumsum(self.spelling[before, byte]))
        out = np.zeros(len(w.hash))
        ends = np.cumsum(size)
        out[new] = total[ends] - total[ends - size] + self.spelling[byte[ends - 1], 256]
        return read.astype(np.int32), ids, out


def class_edges(counts: np.ndarray) -> np.ndarray:
    """First rank of each class, and the end. Classes hold equal shares of the square roots of the
    frequencies, as many as that sum comes to: so the fewest outputs are computed for a word."""
    root = np.sqrt((counts + 0.5) / (counts + 0.5).sum())
    n = max(1, int(np.ceil(root.sum())))
    return np.unique(np.append(np.searchsorted(np.cumsum(root), np.arange(n) * root.sum() / n, "right"), len(counts)))


class Model:
    """Parameters in one flat float32 vector, seen as named arrays. size words are predicted, inputs symbols read.
    Biases of outputs lie beside their weights (cc, uu), so that one product gives both or the gradients of both."""

    def __init__(self, edges: np.ndarray, inputs: int, hidden: int = HIDDEN, flat: np.ndarray | None = None):
        self.edges, self.inputs, self.hidden, self.size, self.classes = edges, inputs, hidden, int(edges[-1]), len(edges) - 1
        self.class_of = np.repeat(np.arange(self.classes, dtype=np.int16 if self.classes < 1 << 15 else np.int64), np.diff(edges))
        shapes = {"e": (inputs, hidden), "x": (3, hidden, hidden), "b": (3, hidden), "r": (3, hidden, hidden), "cc": (hidden + 1, self.classes), "uu": (self.size, hidden + 1)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat
        for (name, shape), end in zip(shapes.items(), ends, strict=True):
            setattr(self, name, self.flat[end - int(np.prod(shape)) : end].reshape(shape))
        self.c, self.cb, self.u, self.ub = self.cc[:hidden], self.cc[hidden], self.uu[:, :hidden], self.uu[:, hidden]

    def like(self, flat: np.ndarray) -> Model:
        return Model(self.edges, self.inputs, self.hidden, flat)

    @staticmethod
    def initial(counts: np.ndarray, inputs: int, hidden: int = HIDDEN) -> Model:
        """Small random weights; the biases are the logarithms of the frequencies."""
        m, rng = Model(class_edges(counts), inputs, hidden), np.random.default_rng(20)
        for name, scale in (("e", 0.3), ("x", 0.2), ("r", 0.2), ("c", 0.1), ("u", 0.1)):
            a = getattr(m, name)
            a[...] = rng.normal(0, scale, a.shape)
        p = (counts + 0.5) / (counts + 0.5).sum()
        mass = np.add.reduceat(p, m.edges[:-1])
        m.cb[...] = np.log(mass)
        m.ub[...] = np.log(p / mass[m.class_of])
        return m

    def inward(self, read: np.ndarray) -> np.ndarray:
        """What the inputs' vectors add to each gate, that of z and r halved."""
        a = read @ (self.x * HALF[:, None])
        a += (self.b * HALF)[:, None]
        return a

    @staticmethod
    def onward(h: np.ndarray, a: np.ndarray, r_half: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, gates z and r, candidate n and the state's part of it, from inward() and r with z's and r's half."""
        s = h @ r_half
        g = a[:2] + s[:2]
        np.tanh(g, out=g)
        g *= np.float32(0.5)
        g += np.float32(0.5)
        z, r = g
        n = r * s[2]
        n += a[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, s[2]

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.onward(h, self.inward(self.e[x]), self.r * HALF[:, None])

    def output(self, h: np.ndarray, y: np.ndarray, grad: Model | None = None, most: np.float32 | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of targets y; with grad, sets the gradients of the outputs that are met there and returns that of h.
        No logit counts as more than MOST_LOGIT: the few calls in which one does are done again with that as most."""
        k, kind = self.hidden, self.flat.dtype
        order = np.argsort(self.class_of[y], kind="stable")
        h1 = np.ones((len(y), k + 1), kind)
        h1[:, :k] = h[order]
        cls, word, sizes = self.class_of[y[order]], y[order], np.diff(self.edges)
        at = np.searchsorted(cls, np.arange(self.classes + 1))
        met = np.diff(at)
        # a class's powers are kept by (word, row), so that products with the few rows of a large class are fast ones
        place = (word - self.edges[cls]) * met[cls] + np.arange(len(y)) - at[cls]
        rows, ones = np.arange(len(y)), np.ones(max(self.classes, int(sizes.max(initial=1))), kind)
        own, total, all_classes, share = np.ones(len(y), kind), np.ones(len(y), kind), np.empty(len(y), kind), np.empty(len(y), kind)
        back, dh = np.zeros((len(y) if grad else 0, k + 1), kind), np.empty((len(y) if grad else 0, k), kind)
        if grad:
            grad.cc.fill(0)
            for c in np.flatnonzero((met == 0) | (sizes == 1)).tolist():
                grad.uu[self.edges[c] : self.edges[c + 1]] = 0

        def powers(e: np.ndarray) -> np.ndarray:
            return np.exp(e if most is None else np.minimum(e, most, out=e), out=e)

        with np.errstate(over="ignore", invalid="ignore"):
            tile = max(1, OUTPUTS // self.classes)
            powers_of_classes = np.empty((min(tile, len(y)), self.classes), kind)
            for lo in range(0, len(y), tile):
                some = slice(lo, min(len(y), lo + tile))
                h_some, its = h1[some], (rows[: some.stop - lo], cls[some])
                e = powers(np.matmul(h_some, self.cc, out=powers_of_classes[: some.stop - lo]))
                sums = np.matmul(e, ones[: self.classes], out=all_classes[some])
                share[some] = mine = e[its]
                if grad:
                    e[its] = mine - sums
                    np.matmul(e, self.c.T, out=dh[some])
                    grad.cc += (h_some / sums[:, None]).T @ e
            share /= all_classes
            if grad:
                dh /= all_classes[:, None]
            bounds, edges = at.tolist(), self.edges.tolist()
            for c in np.flatnonzero((met > 0) & (sizes > 1)).tolist():
                s, t, low, high = bounds[c], bounds[c + 1], edges[c], edges[c + 1]
                hc, u, its = h1[s:t], self.uu[low:high], place[s:t]
                e = powers(u @ hc.T)
                sums = np.matmul(ones[: high - low], e, out=total[s:t])
                flat = e.reshape(-1)
                own[s:t] = mine = flat[its]
                if grad:
                    flat[its] = mine - sums
                    np.matmul(e, hc / sums[:, None], out=grad.uu[low:high])
                    np.matmul(e.T, u, out=back[s:t])
        if most is None and not max(all_classes.max(initial=0), total.max(initial=0)) < np.exp(MOST_LOGIT):
            return self.output(h, y, grad, MOST_LOGIT)
        share *= own / total
        out = np.empty(len(y))
        out[order] = np.log(np.maximum(share, 1e-37))
        if not grad:
            return out, None
        back /= total[:, None]
        dh += back[:, :k]
        back = np.empty_like(dh)
        back[order] = dh
        return out, back


def streams(size: np.ndarray, n_streams: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces spread evenly over streams, longest first, and the streams' lengths, falling."""
    n = max(1, min(n_streams, len(size)))
    lanes: list[list[np.ndarray]] = [[] for _ in range(n)]
    load = np.zeros(n, np.int64)
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), n):  # a round of the longest left goes to the emptiest streams
        some = order[lo : lo + n]
        to = np.argsort(load, kind="stable")[: len(some)]
        for d, t in zip(some.tolist(), to.tolist(), strict=True):
            lanes[t].append(d)
        load[to] += size[some]
    by_load = np.argsort(-load, kind="stable")
    return [np.array(lanes[t], np.int64) for t in by_load], load[by_load]


class Layout(NamedTuple):
    """By (time, stream), streams that are longer first; doc is -1 where a stream is over."""

    x: np.ndarray  # inputs
    y: np.ndarray  # targets
    doc: np.ndarray
    fresh: np.ndarray  # whether the state is 0 before
    width: np.ndarray  # streams that aren't over, by time


def laid_out(read: np.ndarray, ids: np.ndarray, first: np.ndarray, model: Model, end: int, n_streams: int, stretch: int = 0) -> Layout:
    """Documents, each of its words and an end, in streams. The input before a document is the last of the inputs.
    With stretch, longer documents are cut into pieces of so many words."""
    n = np.diff(first)
    begin = first[:-1] + np.arange(len(n))  # a document's place among all words and ends
    word = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
    x_all, y_all = np.full(len(ids) + len(n), model.inputs - 1, np.int32), np.full(len(ids) + len(n), end, np.int32)
    y_all[word], x_all[word + 1 if len(n) else word] = ids, read
    x_all[begin] = model.inputs - 1
    pieces = -(-(n + 1) // stretch) if stretch else np.ones(len(n), np.int64)
    of = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[of] + k * stretch
    size = np.minimum(begin[of] + n[of] + 1 - start, stretch) if stretch else n + 1
    lanes, load = streams(size, n_streams)
    shape = (len(lanes), int(load[0]))
    x, y, doc, fresh = np.full(shape, model.inputs - 1, np.int32), np.zeros(shape, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
    for i, lane in enumerate(lanes):
        m = size[lane]
        t = np.cumsum(m) - m
        at = np.arange(load[i]) + np.repeat(start[lane] - t, m)
        x[i, : load[i]], y[i, : load[i]], doc[i, : load[i]] = x_all[at], y_all[at], np.repeat(of[lane], m)
        fresh[i, t] = True
    return Layout(*(np.ascontiguousarray(v.T) for v in (x, y, doc, fresh)), np.searchsorted(-load, -np.arange(shape[1]), "left"))


def score_documents(model: Model, read: np.ndarray, ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Log-likelihood of every document, its end included."""
    n = len(first) - 1
    out = np.zeros(n)
    if not n:
        return out
    x, y, doc, fresh, width = laid_out(read, ids, first, model, end, SCORE_STREAMS)
    h, r_half = np.zeros((x.shape[1], model.hidden), model.flat.dtype), model.r * HALF[:, None]
    lo = 0
    while lo < len(x):
        b = int(width[lo])
        h = h[:b]
        hi = min(len(x), lo + max(1, (1 << 14) // b))
        states = np.empty((hi - lo, b, model.hidden), h.dtype)
        a = model.inward(model.e[x[lo:hi, :b].ravel()]).reshape(3, hi - lo, b, -1)
        for t in range(lo, hi):
            h[fresh[t, :b]] = 0
            h = states[t - lo] = model.onward(h, a[:, t - lo], r_half)[0]
        own = doc[lo:hi, :b].ravel()
        live = np.flatnonzero(own >= 0)
        p, _ = model.output(states.reshape(-1, model.hidden)[live], y[lo:hi, :b].ravel()[live])
        out += np.bincount(own[live], p, n)
        lo = hi
    return out


def train(model: Model, read: np.ndarray, ids: np.ndarray, first: np.ndarray, end: int, rate: float = RATE) -> float:
    """One pass of truncated backpropagation with Adagrad; returns the mean log-probability on the way."""
    n_streams = max(1, min(STREAMS, len(ids) // (WINDOW * LEAST_STEPS)))
    x, y, doc, fresh, width = laid_out(read, ids, first, model, end, n_streams, STRETCH)
    k, some = model.hidden, model.flat.dtype
    h = np.zeros((x.shape[1], k), some)
    grad, memory = model.like(np.zeros_like(model.flat)), model.like(np.full(len(model.flat), 0.05, np.float32))
    total, seen = 0.0, 0
    for lo in range(0, len(x), WINDOW):
        hi, b = min(len(x), lo + WINDOW), int(width[lo])
        h, r_half = h[:b], model.r * HALF[:, None]
        where, shape = x[lo:hi, :b].ravel(), (hi - lo, b, k)
        read = model.e[where]
        a = model.inward(read).reshape(3, *shape)
        before, z, r, n, s, states = (np.empty(shape, some) for _ in range(6))
        starts = []
        for t in range(hi - lo):
            start = np.flatnonzero(fresh[lo + t, :b])
            before[t] = h
            before[t, start] = 0
            starts.append(start)
            h, z[t], r[t], n[t], s[t] = model.onward(before[t], a[:, t], r_half)
            states[t] = h
        states, target = states.reshape(-1, k), y[lo:hi, :b].ravel()
        live = np.flatnonzero(doc[lo:hi, :b].ravel() >= 0)
        if len(live) == len(target):
            p, d_out = model.output(states, target, grad)
        else:
            p, dh = model.output(states[live], target[live], grad)
            d_out = np.zeros_like(states)
            d_out[live] = dh
        total, seen = total + p.sum(), seen + len(p)
        d_out = d_out.reshape(shape)
        carry = np.zeros((b, k), some)
        d_in, d_state = np.empty((3, *shape), some), np.empty((3, *shape), some)
        by_n, by_z, by_r, back = 1 - n * n, (before - n) * (1 - z), s * r * (1 - r), model.r.transpose(0, 2, 1)
        for t in range(hi - lo - 1, -1, -1):
            carry += d_out[t]
            dz = carry * z[t]
            carry -= dz
            dn = np.multiply(carry, by_n[t], out=d_in[2, t])
            np.multiply(dz, by_z[t], out=d_in[0, t])
            np.multiply(dn, by_r[t], out=d_in[1, t])
            d_state[:2, t] = d_in[:2, t]
            np.multiply(dn, r[t], out=d_state[2, t])
            more = d_state[:, t] @ back
            carry = dz
            for m in more:
                carry += m
            carry[starts[t]] = 0
        d_in, d_state = d_in.reshape(3, -1, k), d_state.reshape(3, -1, k)
        order = np.argsort(where, kind="stable")
        sorted_ = where[order]
        at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        words = sorted_[at]
        d_read = d_in @ model.x.transpose(0, 2, 1)
        d_read[0] += d_read[1]
        d_read[0] += d_read[2]
        grad.e[words] = np.add.reduceat(d_read[0][order], at, axis=0)
        np.matmul(read.T, d_in, out=grad.x)
        d_in.sum(1, out=grad.b)
        np.matmul(before.reshape(-1, k).T, d_state, out=grad.r)
        descend(model, grad, memory, words, 32 / max(1, len(p)), rate)
    return total / max(1, seen)


#: Numbers that are brought up to date together, few enough to stay in a core's cache.
CACHED = 1 << 15


def descend(model: Model, grad: Model, memory: Model, words: np.ndarray, scale: float, rate: float) -> None:
    """One clipped step of Adagrad on the rows words of the inputs' vectors, whose gradients are set to 0 again, and on all that follows these."""
    n = model.e.size
    rows = grad.e[words]
    dense, seen, own = grad.flat[n:], memory.flat[n:], model.flat[n:]
    norm = scale * float(np.sqrt(np.vdot(rows, rows) + np.vdot(dense, dense)))
    scale, rate = np.float32(scale * min(1.0, CLIP / max(norm, CLIP))), np.float32(rate)
    rows *= scale
    m = memory.e[words] + rows * rows
    memory.e[words] = m
    model.e[words] -= rate * rows / np.sqrt(m)
    grad.e[words] = 0
    root = np.empty(CACHED, np.float32)
    squared, step = scale * scale, scale * rate
    for lo in range(0, len(dense), CACHED):
        g, m, p = dense[lo : lo + CACHED], seen[lo : lo + CACHED], own[lo : lo + CACHED]
        q = np.multiply(g, g, out=root[: len(g)])
        q *= squared
        m += q
        np.sqrt(m, out=q)
        np.divide(g, q, out=q)
        q *= step
        p -= q


def least_count(n: np.ndarray, words: np.ndarray, coverage: float, size: int) -> int:
    """The largest count whose words, with all more frequent ones, are at least size and make up
    coverage of all occurrences; words[i] words occur n[i] times."""
    order = np.argsort(-n)
    n, words = n[order], words[order]
    enough = (np.cumsum(n * words) >= coverage * (n * words).sum()) & (np.cumsum(words) >= size)
    return int(n[np.argmax(enough)]) if enough.any() else 1


def bigrams(w: tv.Words) -> np.ndarray:
    """Counts of (byte before, byte) in words: row 256 is before the first byte, column 256 the end of the word."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    byte = w.data[inside].astype(np.int32)
    before = np.append(np.int32(256), byte[:-1])
    size = w.end - w.start
    last = np.cumsum(size)
    before[last - size] = 256
    table = np.bincount(before * 257 + byte, minlength=257 * 257).reshape(257, 257)
    table[:, 256] += np.bincount(byte[last - 1], minlength=257)
    return table


def count_words(docs: DataFrame, size: int = VOCABULARY, coverage: float = COVERAGE) -> Vocabulary:
    """The vocabulary and the byte frequencies, counted over all documents."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, rows = np.zeros((257, 257), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            seen = []
            for part in tv.chunks(batch, "text"):
                w = tv.words(arrow_array(part, "text"))
                if len(w.hash):
                    spelled += bigrams(w)
                    seen.append(np.unique(w.hash, return_counts=True))
            if seen:
                key, n = (np.concatenate(x) for x in zip(*seen, strict=True))
                key, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, n, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])
        some = np.flatnonzero(spelled.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(len(some), 1, np.int32), np.int32(2))), pa.array(np.append(some, 0)), pa.array(np.append(spelled.ravel()[some], rows))], names=["kind", "key", "n"])

    counts = written(mapped(docs.select("text"), run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    spelled = np.zeros(257 * 257)
    rows = 0
    for r in counts.filter("kind > 0").collect():
        if r["kind"] == 1:
            spelled[r["key"]] = r["n"]
        else:
            rows = r["n"]
    frequent = counts.filter("kind = 0").groupBy("n").count().toArrow()
    least = least_count(frequent.column("n").to_numpy().astype(float), frequent.column("count").to_numpy().astype(float), coverage, size)
    top = counts.filter((F.col("kind") == 0) & (F.col("n") >= least)).toArrow()
    total = float(counts.filter("kind = 0").agg(F.sum("n")).first()[0] or 0)
    drop(counts)
    key, n = top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(float)
    every = np.append(n, [total - n.sum(), rows])
    order = np.lexsort((np.append(key, np.array([0, 1], np.uint64)), -every))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_key = np.argsort(key)
    spelled = spelled.reshape(257, 257)
    # a pair never seen is as likely as its second byte, at the weight of one occurrence
    alone = (spelled.sum(0) + 0.5) / (spelled.sum() + 0.5 * 257)
    spelled = np.log((spelled + alone) / (spelled.sum(1, keepdims=True) + 1))
    return Vocabulary(key[by_key], rank[by_key], every[order], int(rank[-2]), int(rank[-1]), spelled)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, most: int) -> Iterator[tuple]:
    """(doc_ids, words as read, as predicted, first word of each document, its spelling, its unknown words) of about most words at once."""
    got: list[tuple] = []
    have = 0

    def joined() -> tuple:
        ids, read, y, size, spelling, unknown = zip(*got, strict=True)
        return pa.concat_arrays(ids), np.concatenate(read), np.concatenate(y), np.append(0, np.cumsum(np.concatenate(size))), np.concatenate(spelling), np.concatenate(unknown)

    for batch in batches:
        for part in tv.chunks(batch, "text"):
            w = tv.words(arrow_array(part, "text"))
            read, ids, spelling = vocabulary.encode(w)
            sums = [np.append(0, np.cumsum(v)) for v in (spelling, ids == vocabulary.unknown)]
            got.append((arrow_array(part, "doc_id").cast(pa.int64()), read, ids, np.diff(w.first), *(v[w.first[1:]] - v[w.first[:-1]] for v in sums)))
            have += len(ids) + part.num_rows
            if have >= most:
                yield joined()
                got, have = [], 0
    if got:
        yield joined()


def shards_of(vocabulary: Vocabulary, parameters: int, rounds: int, documents: int, shard_documents: int, words_a_parameter: float) -> int:
    """As many shards a round as leave each of them enough documents, and words for the parameters that it sends."""
    words = vocabulary.counts.sum() - vocabulary.counts[vocabulary.end]
    return max(1, min(documents // (rounds * shard_documents), int(words / rounds / (words_a_parameter * parameters))))


def fit(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, shard_documents: int = SHARD_DOCUMENTS, words_a_parameter: float = WORDS_A_PARAMETER) -> Model:
    """Average of the shards' models, round after round; every document with an id is trained on in one round."""
    spark = docs.sparkSession
    model = Model.initial(vocabulary.counts, vocabulary.inputs)
    some = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    n = some.select("doc_id").count()
    if not n:
        return model
    sent_vocabulary = spark.sparkContext.broadcast(vocabulary)
    cuts = np.linspace(0, len(model.flat), BLOCKS + 1).astype(int)
    shards = shards_of(vocabulary, len(model.flat), rounds, n, shard_documents, words_a_parameter)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mine, words, v = sent.value.like(sent.value.flat.copy()), 0, sent_vocabulary.value
            for _, read, ids, first, *_ in _encoded(batches, v, SCORE_WORDS):
                train(mine, read, ids, first, v.end)
                words += len(ids)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, float(words))), pa.array([mine.flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["block", "weight", "part"])

        part = some.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == turn)
        trained = mapped(part.repartition(shards, F.xxhash64("doc_id", F.lit("shard"))).sortWithinPartitions("doc_id", "text"), run, "block int, weight double, part binary")
        blocks = mapped(trained.repartition("block"), _averaged, "block int, weight double, part binary").toArrow().sort_by("block")
        if blocks.num_rows:
            model = model.like(np.concatenate([np.frombuffer(x, np.float32) for x in blocks.column("part").to_pylist()]).copy())
        sent.destroy()
    sent_vocabulary.destroy()
    return model


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the parts of each block."""
    total: dict[int, list] = {}
    for batch in batches:
        for block, weight, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            have = total.setdefault(block, [0.0, 0.0])
            have[0] += weight
            have[1] = have[1] + weight * np.frombuffer(part, np.float32).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([w for w, _ in total.values()]), pa.array([(s / w).astype(np.float32).tobytes() for w, s in total.values()], pa.binary())], names=["block", "weight", "part"])


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_unknown, log_likelihood, perplexity) of every row."""
    vocabulary = count_words(docs)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, fit(docs, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = sent.value
        for doc_id, read, ids, first, spelling, unknown in _encoded(batches, vocabulary, SCORE_WORDS):
            n = np.diff(first)
            p = score_documents(model, read, ids, first, vocabulary.end) + spelling
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n), pa.array(unknown), pa.array(p), pa.array(np.exp(np.minimum(-p / (n + 1), 700)))], names=["doc_id", "n_words", "n_unknown", "log_likelihood", "perplexity"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, n_unknown bigint, log_likelihood double, perplexity double")
