"""Vectorised text primitives over Arrow string columns.

A chunk of documents is one byte buffer plus offsets. Words are maximal runs of
Unicode letters, digits and combining marks, after lower-casing; of scripts that
are written without spaces (Han, Kana, Thai, Lao, Burmese, Khmer) each letter with
its marks is a word. Dashes, quotes and spaces of any kind part words. The empty
text and null have none. Hashes are polynomial prefix sums modulo 2**64 with an odd
base, so the hash of any byte or word span is two look-ups.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = {"p": np.ones(1, U64), "q": np.ones(1, U64)}

IS_WORD = np.zeros(256, bool)
IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[ord("A") : ord("Z") + 1] = IS_WORD[ord("0") : ord("9") + 1] = True

#: Classes of code points: no part of a word, part of a run, a word of its own, a mark that joins what stands before it.
NONE, RUN, OWN, MARK = range(4)
#: Beyond it no letters are assigned.
LAST_LETTER = 0x323AF
#: Scripts without spaces.
_OWN = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, LAST_LETTER))


@lru_cache
def classes() -> np.ndarray:
    """The class of every code point; variation selectors are no letters' marks."""
    kind = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(LAST_LETTER + 1)).encode(), np.uint8)
    out = np.where((kind == ord("L")) | (kind == ord("N")), RUN, np.where(kind == ord("M"), MARK, NONE)).astype(np.uint8)
    for low, high in _OWN:
        part = out[low : high + 1]
        part[part == RUN] = OWN
    out[0xFE00:0xFE10] = NONE
    out[[0xA7CB, 0xA7DC]] = RUN  # newer letters, which Arrow lower-cases
    return np.append(out, np.uint8(NONE))

#: Bytes of text handled at once: temporaries stay in cache and far below a worker's memory.
CHUNK_BYTES = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=U64)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash; values are uint64 or bytes."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal content wherever it stands."""
    _, q = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(U64))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about size bytes of text, a longer text alone."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(lengths), 0
    while at < len(lengths):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + size, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # of documents in data
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _wide(data: np.ndarray, inside: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marks the bytes of words outside ASCII in inside; the places, besides edges, where one word ends and another may begin."""
    lead = np.flatnonzero(data >= 0xC0)
    size = np.where(data[lead] >= 0xF0, 4, np.where(data[lead] >= 0xE0, 3, 2))
    code = data[lead].astype(np.int32) & np.array([0, 0, 31, 15, 7])[size]
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[lead[more] + k] & 63
    kind = classes()[np.minimum(code, LAST_LETTER + 1)]
    for k in range(4):
        inside[lead[(size > k) & (kind != NONE)] + k] = True
    own = kind == OWN
    if not own.any():
        return lead[:0]
    after = lead[own] + size[own]
    begin, end = lead[kind == MARK], (lead + size)[kind == MARK]
    if len(begin):  # the word goes on to the end of the run of marks behind its letter
        last = np.flatnonzero(np.append((begin[1:] != end[:-1]) | np.isin(end[:-1], edges), True))
        run_end = end[last[np.searchsorted(last, np.arange(len(begin)))]]
        at = np.minimum(np.searchsorted(begin, after), len(begin) - 1)
        after = np.where((begin[at] == after) & ~np.isin(after, edges), run_end[at], after)
    return np.concatenate([lead[own], after])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = IS_WORD[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    if len(data) and data.max() >= 128:
        own = _wide(data, inside, edges)
        edges = np.concatenate([edges, own[(own > 0) & (own < len(data))]])
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return start, np.flatnonzero(inside & ~after) + 1


def words(text: pa.Array) -> Words:
    data, offsets = buffers(pc.utf8_lower(text))
    start, end = word_bounds(data, offsets)
    return Words(data, offsets, start, end, span_hash(prefix_hash(data), start, end), np.searchsorted(start, offsets))


def original_bounds(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, word starts and ends of the text as it is. Lower-casing keeps the class
    of every character, so the n-th word here is the n-th of words()."""
    data, offsets = buffers(text)
    return (data, offsets, *word_bounds(data, offsets))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every n-word shingle; a document of 1 to n - 1 words is one shingle."""
    count = np.diff(w.first)
    prefix = prefix_hash(w.hash)
    take = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), take)
    start = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + w.first[doc]
    return span_hash(prefix, start, start + np.minimum(count, n)[doc]), doc


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of width values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out
