"""Exact top-k search on a bit-sliced index.

Every attribute of the normalised vectors is quantised to a few bits and kept as bit
slices, one bitmap over the rows for each attribute and bit. A query's own values are
quantised to small signed weights; a negative weight takes the complement of a slice.
The weighted sum of all attributes is formed by adding slices with bitmap arithmetic:
carry-save adders reduce three bitmaps of a position to a sum and a carry until one
is left. From the most significant slice of the sum downward the k-th best value is
found; every row that the quantisation errors leave within reach of it is a boundary
row, and those are resolved by their exact similarity, so the result is exact.

The queries are the rows whose id is divisible by EVERY, each against all other rows.
The table is cut into blocks by hash of the id; every block is sliced once and its
slices are written. Queries travel to the blocks in waves of bounded size; a task
merges the best of its blocks, so k rows a query and task are shuffled.

Similarity is the cosine, ranked after rounding to 9 digits, ties by id. Defined cases:
rows without id or vector, and zero vectors, have no neighbours and are none; nulls
within a vector are 0, shorter vectors are padded with 0; of rows with the same id the
first in vector order counts, so repeated rows count once; fewer than k other rows give
fewer results; an empty table gives none; very long vectors make blocks of fewer rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from quillstack.llm.common import BROADCAST_BYTES, arrow_array, drop, grouped, int_column, mapped, prepare, written

K, EVERY, BITS, WEIGHT_BITS = 10, 50, 6, 5
#: Rows and bytes of vectors of a block at most.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
DIGITS = 9


class Index:
    """Bit slices of the unit vectors of a block; slices are made unless they were stored."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bits: int = BITS, stored: np.ndarray | None = None):
        self.ids, self.x, self.n, self.bits = ids, x, len(ids), bits
        low, high = x.min(0), x.max(0)
        self.step = np.maximum((high - low) / ((1 << bits) - 1), 1e-12)
        level = np.clip(np.rint((x - low) / self.step), 0, (1 << bits) - 1).astype(np.uint8)
        self.residual = float(np.sqrt(((x - low - level * self.step) ** 2).sum(1).max(initial=0)))
        words = -(-self.n // 64)
        self.all = self.packed(np.ones(self.n, bool), words)
        plain = np.stack([[self.packed((level[:, j] >> t) & 1 > 0, words) for t in range(bits)] for j in range(x.shape[1])]) if stored is None else stored.reshape(x.shape[1], bits, words)
        self.slices = np.stack([plain, ~plain & self.all])  # sign, attribute, bit, words

    @staticmethod
    def packed(mask: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        raw = np.packbits(mask, bitorder="little")
        out[: len(raw)] = raw
        return out.view(np.uint64)

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """Slices, least significant first, of sum |w| * level (or its complement where w < 0)."""
        size = np.abs(weights)
        columns: dict[int, list[np.ndarray]] = {}
        for s in range(int(size.max(initial=0)).bit_length()):
            use = np.flatnonzero((size >> s) & 1)
            part = self.slices[(weights[use] < 0).astype(int), use]
            for t in range(self.bits):
                columns.setdefault(s + t, []).append(part[:, t])
        out, position = [], 0
        while position <= max(columns, default=-1):
            a = np.concatenate(columns.pop(position, [np.zeros((1, len(self.all)), np.uint64)]))
            carries = []
            while len(a) > 1:
                m = len(a) // 3
                if m:
                    p, q, r = a[:m], a[m : 2 * m], a[2 * m : 3 * m]
                    half = p ^ q
                    carries.append((p & q) | (r & half))
                    a = np.concatenate([half ^ r, a[3 * m :]])
                else:
                    carries.append(a[:1] & a[1:])
                    a = a[:1] ^ a[1:]
            if carries:
                columns.setdefault(position + 1, []).extend(carries)
            out.append(a[0])
            position += 1
        return np.array(out).reshape(len(out), len(self.all))

    def at_least(self, slices: np.ndarray, value: int) -> np.ndarray:
        """Bitmap of the rows whose sum is at least value."""
        if value <= 0:
            return self.all
        if value >= 1 << len(slices):
            return np.zeros_like(self.all)
        above, equal = np.zeros_like(self.all), self.all
        for t in range(len(slices) - 1, -1, -1):
            if value >> t & 1:
                equal = equal & slices[t]
            else:
                above = above | (equal & slices[t])
                equal = equal & ~slices[t]
        return above | equal

    def kth(self, slices: np.ndarray, k: int) -> int:
        """The k-th greatest sum, from the most significant slice downward."""
        inside, tied, value, have = np.zeros_like(self.all), self.all, 0, 0
        for t in range(len(slices) - 1, -1, -1):
            ones = tied & slices[t]
            n = have + int(np.bitwise_count(ones).sum())
            if n >= k:
                tied, value = ones, value | 1 << t
            else:
                inside, have = inside | ones, n
                tied = tied & ~slices[t]
        return value

    def search(self, q: np.ndarray, own: int, k: int, weight_bits: int = WEIGHT_BITS) -> tuple[np.ndarray, np.ndarray]:
        """The best k rows of the block for unit vector q, without the row of id own: places and similarities."""
        # the attributes' steps are part of the weights, so one integer sum stands for the product
        scaled = q * self.step
        unit = float(np.abs(scaled).max()) / ((1 << weight_bits) - 1)
        if self.n > 2 * k and unit > 0:
            weights = np.rint(scaled / unit).astype(np.int64)
            slices = self.summed(weights)
            used = weights * unit / self.step  # the query that the weights stand for
            # |x| is 1 at most, and q.x = used.xhat + used.(x - xhat) + (q - used).x
            error = float(np.linalg.norm(used)) * self.residual + float(np.linalg.norm(q - used))
            limit = self.kth(slices, min(self.n, k + 1)) - int(np.ceil((2 * error + 1e-8) / unit)) - 1
            bitmap = self.at_least(slices, limit)
            rows = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])
        else:
            rows = np.arange(self.n)
        rows = rows[self.ids[rows] != own]
        score = np.round((self.x[rows] * q).sum(1), DIGITS)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Unit vectors, padded to width; nulls are 0."""
    column = arrow_array(batch, "embedding")
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, width))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1)[:, None]


SLICED = "ids binary, vectors binary, slices binary"
FOUND = "vec_id bigint, neighbor_id bigint, score double"


def _sliced(width: int, block_rows: int):
    """For mapInArrow over (block, vec_id, embedding) sorted by block, vec_id: one row a block of block_rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["block"]):
            for batch in table.combine_chunks().to_batches():
                block, ids = int_column(batch, "block"), int_column(batch, "vec_id")
                at = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
                for s, e in ((i, min(i + block_rows, e)) for s, e in zip(at[:-1], at[1:], strict=True) for i in range(s, e, block_rows)):
                    ix = Index(ids[s:e], vectors(batch.slice(s, e - s), width))
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ix.ids, ix.x, ix.slices[0])], names=["ids", "vectors", "slices"])

    return run


def _best(own: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each own by score, ties by id."""
    order = np.lexsort((found, -score, own))
    own, found, score = own[order], found[order], score[order]
    keep = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[keep], found[keep], score[keep]


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS, wave_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(vec_id, neighbor_id, rank, score): for every row whose id is divisible by every, its k most similar other rows."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter("vec_id is not null and exists(embedding, v -> v is not null and v <> 0)")
    rows = written(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    width, n, asked = rows.agg(F.max(F.size("embedding")), F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    out = spark.createDataFrame([], FOUND)
    if n and asked:
        block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * width)))
        blocks = -(-n // block_rows)
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
        index = written(mapped(rows.withColumn("block", block).repartition(blocks, "block").sortWithinPartitions("block", "vec_id"), _sliced(width, block_rows), SLICED))
        waves = -(-asked * width * 8 // wave_bytes)
        for wave in range(waves):
            table = queries.filter(F.pmod(F.xxhash64(F.lit("wave"), "vec_id"), F.lit(waves)) == wave).toArrow().sort_by("vec_id").combine_chunks()
            if not table.num_rows:
                continue
            batch = table.to_batches()[0]
            sent = spark.sparkContext.broadcast((int_column(batch, "vec_id"), vectors(batch, width)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, x = sent.value
                best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for batch in batches:
                    for row in range(batch.num_rows):
                        own, vector, stored = (np.frombuffer(arrow_array(batch, c)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("vectors", float), ("slices", np.uint64)))
                        ix = Index(own, vector.reshape(-1, width), stored=stored)
                        parts = [ix.search(q, i, k) for i, q in zip(ids, x, strict=True)]
                        place, score = (np.concatenate(p) for p in zip(*parts, strict=True))
                        best = _best(np.append(best[0], np.repeat(ids, [len(p) for p, _ in parts])), np.append(best[1], ix.ids[place]), np.append(best[2], score), k)
                if len(best[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in best], names=["vec_id", "neighbor_id", "score"])

            out = out.union(mapped(index, run, FOUND))
        out = written(out)
        drop(index)
    drop(rows)
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT vec_id, neighbor_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10
"""
