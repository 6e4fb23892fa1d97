"""Hash-projected embeddings: each token's values come from a 32-bit string hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quillstack.functions import jstext as js, tokens as tk

DIM = 128


def string_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


_SHIFT = np.array([31 ** len(str(d)) for d in range(DIM)], np.uint32)
_TAIL = np.array([string_hash(str(d)) & 0xFFFFFFFF for d in range(DIM)], np.uint32)


def _values(base: np.ndarray) -> np.ndarray:
    """Token vectors from the hashes of "token:"; the remainder keeps the sign of the hash."""
    h = (base.astype(np.uint32)[:, None] * _SHIFT + _TAIL).view(np.int32).astype(np.int64)
    return np.fmod(h, 10000) / 5000 - 1


def token_vectors(tokens: list[str]) -> np.ndarray:
    return _values(np.array([string_hash(t + ":") & 0xFFFFFFFF for t in tokens], np.uint32)) if tokens else np.zeros((0, DIM))


def embed_text(text: str, cache: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """The mean of the token vectors, scaled to length 1; zeros without tokens."""
    return embed_tokens(js.py_tokenize(text), cache if cache is not None else {})


def embed_tokens(tokens: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
    new = [t for t in dict.fromkeys(tokens) if t not in cache]
    cache.update(zip(new, token_vectors(new), strict=True))
    if not tokens:
        return np.zeros(DIM)
    mean = np.mean([cache[t] for t in tokens], axis=0)
    norm = np.sqrt((mean * mean).sum())
    return mean / norm if norm else np.zeros(DIM)


def _hashes(tokens: pa.Array) -> np.ndarray:
    """string_hash of "token:" for ASCII tokens, modulo 2 ** 32: the bytes times powers of 31, summed."""
    data, off = tk.buffers(tokens)
    size = np.diff(off)
    if not len(data):
        return np.full(len(tokens), ord(":"), np.uint32)
    power = np.cumprod(np.append(np.uint32(1), np.full(int(size.max()), 31, np.uint32)), dtype=np.uint32)
    after = np.repeat(off[1:], size) - np.arange(len(data))  # bytes from each on, which the colon follows
    part = np.append(data.astype(np.uint32) * power[after], np.uint32(0))
    return np.where(size > 0, np.add.reduceat(part, off[:-1], dtype=np.uint32), np.uint32(0)) + np.uint32(ord(":"))


def _steps(base: np.ndarray) -> np.ndarray:
    """5000 times the token vectors, which are whole numbers then."""
    h = (base[:, None] * _SHIFT + _TAIL).view(np.int32)
    return (np.fmod(h, np.int32(10000)) - np.int32(5000)).astype(np.int16)


#: Tokens whose vectors are taken together.
TOKENS_AT_ONCE = 1 << 14


def _embedded_array(text: pa.Array) -> pa.Array:
    """The mean direction of the tokens of each lower-cased text. Vectors are summed as whole numbers, so no order of
    the tokens matters, and the mean needs no division: its length is made 1."""
    out = []
    for piece in tk.pieces(iter([pa.RecordBatch.from_arrays([text], names=["text"])])):
        tokens, size = tk.tokens_of(piece.column("text"))
        coded = tokens.dictionary_encode()
        vectors, code = _steps(_hashes(coded.dictionary)), coded.indices.to_numpy()
        total = np.zeros((len(size), DIM))
        some = np.flatnonzero(size)
        at = np.append(0, np.cumsum(size[some]))
        s = 0
        while s < len(some):
            e = max(s + 1, int(np.searchsorted(at, at[s] + TOKENS_AT_ONCE, "right")) - 1)
            if e == s + 1:  # a long text, which is summed in stretches
                for k in range(at[s], at[e], TOKENS_AT_ONCE):
                    total[some[s]] += vectors[code[k : min(at[e], k + TOKENS_AT_ONCE)]].sum(0, dtype=np.int64)
            else:
                total[some[s:e]] = np.add.reduceat(vectors[code[at[s] : at[e]]], at[s:e] - at[s], axis=0, dtype=np.int32)
            s = e
        norm = np.sqrt((total * total).sum(1))
        total /= np.where(norm > 0, norm, 1)[:, None]
        out.append(total)
    value = np.concatenate(out) if out else np.zeros((0, DIM))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, value.size + 1, DIM), pa.int32()), pa.array(value.ravel()))


_embedded = F.arrow_udf(_embedded_array, T.ArrayType(T.DoubleType()))


def span_embeddings(spans: DataFrame) -> DataFrame:
    """(corpus_id, span_id, embedding); Arrow batches, each token's vector made once for some megabytes of text."""
    return spans.select("corpus_id", "span_id", _embedded(F.lower("text")).alias("embedding"))


def token_summaries(tokens: DataFrame) -> DataFrame:
    """(token, dims, total, low, high) of the vectors of a table of tokens: a row each, and no row for a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, TOKENS_AT_ONCE):
                token = batch.column("token").slice(s, TOKENS_AT_ONCE)
                v = _steps(_hashes(token))
                total, low, high = v.sum(1, dtype=np.int64), v.min(1), v.max(1)
                yield pa.RecordBatch.from_arrays([token, pa.array(np.full(len(token), DIM)), *(pa.array(x / 5000) for x in (total, low, high))], names=["token", "dims", "total", "low", "high"])

    return tokens.select("token").mapInArrow(run, "token string, dims bigint, total double, low double, high double")


def hash_column(text: Column) -> Column:
    """string_hash as a column, in 64-bit arithmetic that can't overflow."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def token_embedding_rows(tokens: DataFrame, dims: int = DIM) -> DataFrame:
    """(token, dim, value) of a table of tokens, in expressions alone; the affine form of the hash."""
    table = F.broadcast(tokens.sparkSession.createDataFrame([(d, int(_SHIFT[d]), int(_TAIL[d])) for d in range(dims)], "dim int, shift bigint, tail bigint"))
    base = tokens.select("token", F.pmod(hash_column(F.concat("token", F.lit(":"))), F.lit(1 << 32)).alias("base"))
    h = F.pmod(F.col("base") * F.col("shift") + F.col("tail"), F.lit(1 << 32))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return base.crossJoin(table).select("token", "dim", (signed % 10000 / F.lit(5000.0) - 1).alias("value"))


def dot(a: Column, b: Column) -> Column:
    """Raises where the sizes differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    message = F.concat(F.lit("Vector dimension mismatch: "), F.size(a).cast("string"), F.lit(" vs "), F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(message).cast("double"))


def cosine_scores(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """embeddings with score: the dot product with the query; rows without a vector are left out."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    return embeddings.filter(F.size("embedding") > 0).withColumn("score", dot(F.col("embedding"), vector))


def semantic_scores(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """(corpus_id, span_id, semantic): cosine_scores() without the vectors, a batch's products at once, in the worker that made them."""
    vector = np.asarray(query, float)

    def products(embedding: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(embedding), 0).to_numpy(zero_copy_only=False)
        out = np.full(len(size), np.nan)
        if len(odd := size[(size > 0) & (size != len(vector))]):
            raise ValueError(f"Vector dimension mismatch: {odd[0]} vs {len(vector)}")
        out[size > 0] = embedding.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(vector)) @ vector
        return pa.array(out, mask=size == 0)

    return embeddings.select("corpus_id", "span_id", F.arrow_udf(products, T.DoubleType())(F.col("embedding")).alias("semantic"))
