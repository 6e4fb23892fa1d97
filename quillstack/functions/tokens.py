"""Tokens of Arrow batches of texts by their bytes, counted and sorted without a shuffle.

Texts come lower-cased: a token is then a run of a-z and 0-9, as jstext.TOKEN has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken together; a longer text alone.
MOST_BYTES = 1 << 20

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text begins in them (and the last ends); nulls are empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in batches of about so many bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        off = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        s = 0
        while s < batch.num_rows:
            e = max(s + 1, int(np.searchsorted(off, off[s] + most, "right")) - 1)
            held.append(batch.slice(s, e - s))
            size += off[e] - off[s]
            s = e
            if size >= most or s < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokens_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens, one after another, and each text's number of them."""
    data, off = buffers(text)
    own = _IN_TOKEN[data]
    before, after = np.zeros(len(own), bool), np.zeros(len(own), bool)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[off[:-1][off[:-1] < len(own)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
    at = np.append(0, np.cumsum(end - start))
    whole = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[own]))])
    return whole, np.diff(np.searchsorted(start, off))


def counted(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, token, tf) of the distinct tokens of each text, by token and then by row, and each text's number of tokens."""
    tokens, size = tokens_of(text)
    coded = tokens.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[coded.indices.to_numpy()] * max(1, len(text)) + np.repeat(np.arange(len(text)), size)
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    place, row = np.divmod(key[at], max(1, len(text)))
    return row, coded.dictionary.take(pa.array(order)).take(pa.array(place)).cast(pa.string()), np.diff(np.append(at, len(key))), size
