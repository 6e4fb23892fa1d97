"""MinHash near-dedup with BagMinHash signatures of weighted shingles.

A document is a multiset of word trigrams. Each (shingle, weight interval) carries
a Poisson process in time whose points fall on a uniformly random component and a
uniformly random place of the interval. The intervals [0,1), [1,2), [2,4), [4,8)...
halve the weight axis, so a shingle of weight w needs about log2 w processes; of the
last, partly covered one, only points below w count. A component's value is its
earliest point over all processes: two documents share it with probability equal to
their weighted Jaccard similarity. Only points before a time at which all components
are very likely hit are generated; documents with a component left out try again
with twice the time, so the result never depends on that bound.

Documents with equal multisets are of one class from the start: one of each goes on.
Signatures are cut into bands. Rows of a bucket whose sketches agree are linked,
links are contracted to candidate groups, and inside each group the multisets
themselves decide: documents are joined by overlap of at least the threshold,
transitively. The least doc_id of a class is kept. Groups of any size are clustered
by tasks of bounded size (see common.clustered).

Defined cases: a document of one or two words is a single shingle; null or empty
text, or text without words, is in no group; very long texts take part whole; rows
with the same doc_id are one document, with the words of all of them; null doc_ids
pass and are never grouped; of a tie in similarity nothing depends, as the least
doc_id is kept; an empty table gives an empty table; other columns, whatever their
names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm import textvec as tv
from quillstack.llm.common import GROUP_BYTES, HOT_ROWS, SAMPLED, Run, arrow_array, bucket_links, clustered, connected_components, drop, hot_keys, inside, int_column, mapped, prepare, run_starts, without, written

SHINGLE, COMPONENTS, BAND_ROWS, THRESHOLD = 3, 160, 4, 0.5
#: Within a bucket so large a share of the first components must agree in 2 bits: 0.625 is expected at similarity 0.5.
SKETCH_COMPONENTS, SKETCH_AGREE = 128, 0.53
#: Shingles of which similar documents have one in common.
EARLY = 24
#: A shingle's hash and weight share 64 bits.
WEIGHT_BITS = np.uint64(24)


def bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted; the shingle keeps 40 bits of its hash."""
    key, doc = tv.shingles(tv.words(text), SHINGLE)
    x = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    at = run_starts(x)
    x = x[at[:-1]]
    return (x >> np.uint64(40)).astype(np.int64), x & np.uint64((1 << 40) - 1), np.diff(at)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """n rows of m components; rows without shingles are zero."""
    out = np.zeros((n, m), np.uint64)
    total = np.bincount(doc, weight, n)
    limit = (np.log(m) + 4) / np.maximum(total, 1)
    todo = total > 0
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(int) + 1
    element = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    span = np.where(level == 0, 1, low)
    seed = tv.mix(shingle[element] + (level.astype(np.uint64) << np.uint64(48)) + np.uint64(0x5851F42D4C957F2D))
    owner, room = doc[element], weight[element] - low
    while todo.any():
        live = np.flatnonzero(todo[owner])
        time = np.zeros(len(live))
        best = np.full(n * m, np.inf)
        turn = 0
        while len(live):
            r = tv.mix(seed[live] + tv.mix(np.full(1, turn, np.uint64)))
            time = time - np.log(_uniform(r)) / (m * span[live])
            early = time <= limit[owner[live]]
            live, time, r = live[early], time[early], r[early]
            q = tv.mix(r + np.uint64(0xD1B54A32D192ED03))
            place = (q >> np.uint64(32)).astype(np.float64) * span[live] / (1 << 32)
            hit = place < room[live]
            np.minimum.at(best, owner[live[hit]] * m + (q[hit] % np.uint64(m)).astype(np.int64), time[hit])
            turn += 1
        best = best.reshape(n, m)
        done = todo & np.isfinite(best).all(1)
        out[done] = best[done].view(np.uint64)
        todo &= ~done
        limit = limit * 2
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """2 bits of every component, 32 of them in each 64-bit word."""
    x = (tv.mix(sig) & np.uint64(3)).reshape(len(sig), sig.shape[1] // 32, 32)
    return (x << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def sketches_agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether at least SKETCH_AGREE of the 2-bit fields are equal."""
    x = (a ^ b).view(np.uint64)
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1)
    return differ <= (1 - SKETCH_AGREE) * 32 * x.shape[-1]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    key = np.zeros((n, m // rows), np.uint64)
    for i in range(rows):
        key = tv.mix(key * np.uint64(31) + sig[:, i::rows][:, : m // rows])
    return tv.mix(key + np.arange(m // rows, dtype=np.uint64)[None, :])


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with a doc_id and a text."""
    return batch.filter(pa.compute.is_valid(arrow_array(batch, "doc_id"))) if arrow_array(batch, "doc_id").null_count else batch


def packed(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shingles with their weights, of at most 2**24 - 1, as int64."""
    return ((key << WEIGHT_BITS) | np.minimum(weight, (1 << 24) - 1).astype(np.uint64)).view(np.int64)


def unpacked(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = value.view(np.uint64)
    return x >> WEIGHT_BITS, (x & np.uint64((1 << 24) - 1)).astype(np.int64)


def overlap_one(value: np.ndarray, off: np.ndarray, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the weighted Jaccard similarity of row i of value, between off, and each other is high enough."""
    mine, w = unpacked(value[off[i] : off[i + 1]])
    size = off[others + 1] - off[others]
    row = np.arange(size.sum()) + np.repeat(off[others] - np.cumsum(size) + size, size)
    key, weight = unpacked(value[row])
    at = np.minimum(np.searchsorted(mine, key), len(mine) - 1)
    owner = np.repeat(np.arange(len(others)), size)
    both = np.bincount(owner, np.where(mine[at] == key, np.minimum(w[at], weight), 0), len(others))
    return both >= threshold * (w.sum() + np.bincount(owner, weight, len(others)) - both)


def overlap_pairs(value: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.array([overlap_one(value, off, i, np.array([j]), threshold)[0] for i, j in zip(a, b, strict=True)], bool)


def early_shingles(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the EARLY shingles of each row whose first point in time, at the rate of their weight, is earliest.
    Similar rows all but certainly have one in common."""
    key, weight = unpacked(value)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = -np.log(_uniform(tv.mix(key + np.uint64(0x2545F4914F6CDD1D)))) / np.maximum(weight, 1)
    order = np.lexsort((first, row))
    use = order[np.arange(len(row)) - off[row] < EARLY]
    return row[use], key[use]


def _bag_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2) of each row with words: 128 bits of its multiset."""
    for batch in batches:
        for part in tv.chunks(_whole(batch), "text"):
            doc, key, weight = bags(arrow_array(part, "text"))
            at = run_starts(doc)[:-1]
            each = [np.add.reduceat(tv.mix(key + np.uint64(seed)) * weight.astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64) for seed in (1 << 50, 1 << 51)]
            yield pa.RecordBatch.from_arrays([pa.array(int_column(part, "doc_id")[doc[at]]), *(pa.array(h.view(np.int64)) for h in each)], names=["doc_id", "h1", "h2"])


def equal_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep): the documents whose multiset another one with a smaller doc_id has, and the least of these;
    and the doc_ids of several rows, which are not compared here. Both written."""
    rows = mapped(docs.select("doc_id", "text"), _bag_hashes, "doc_id bigint, h1 bigint, h2 bigint")
    each = written(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h1").alias("h1"), F.min("h2").alias("h2")))
    single = each.filter("n = 1")
    least = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "rep")
    copies = written(single.join(least, ["h1", "h2"]).filter("doc_id <> rep").select("doc_id", "rep"))
    several = written(each.filter("n > 1").select("doc_id"))
    drop(each)
    return copies, several


def _bands(components: int, band_rows: int, pick: Callable[[np.ndarray], np.ndarray], sketched: int) -> Run:
    """For mapInArrow over documents: (key, id, sketches) of the bands whose keys are picked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(_whole(batch), "text"):
                doc, key, weight = bags(arrow_array(part, "text"))
                n = part.num_rows
                sig = signatures(doc, key, weight, n, components)
                some = np.bincount(doc, minlength=n) > 0
                ids, sig = int_column(part, "doc_id")[some], sig[some]
                keys = band_keys(sig, band_rows)
                b = keys.shape[1]
                keys = keys.reshape(-1).view(np.int64)
                use = np.flatnonzero(pick(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array(ids[use // b]), *(pa.array(x[use // b].view(np.int64)) for x in sketches(sig[:, :sketched]).T)], names=["key", "id", *_names(sketched)])

    return run


def _names(sketched: int) -> list[str]:
    return [f"sketch{i}" for i in range(sketched // 32)]


def candidate_groups(docs: DataFrame, components: int = COMPONENTS, band_rows: int = BAND_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, comp) of documents that share a bucket and a sketch with another, transitively. Documents that share
    a bucket with very many are candidates without a look at their sketches."""
    sketched = min(components, SKETCH_COMPONENTS) // 32 * 32
    schema = "key bigint, id bigint, " + ", ".join(f"{x} bigint" for x in _names(sketched))
    docs = docs.select("doc_id", "text")
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    hot = hot_keys(mapped(some, _bands(components, band_rows, lambda k: np.ones(len(k), bool), sketched), schema).select("key"), max(1, hot_rows // SAMPLED))
    stars = mapped(docs, _bands(components, band_rows, lambda k: inside(hot, k), sketched), schema).select(F.col("key").alias("a"), F.col("id").alias("b")) if len(hot) else None
    rows = mapped(docs, _bands(components, band_rows, lambda k: ~inside(hot, k), sketched), schema)
    return connected_components(rows.repartition("key").sortWithinPartitions("key", "id"), links=bucket_links(sketches_agree, tuple(_names(sketched))), more=stars)


def _packed_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (comp, id, text): (comp, id, data)."""
    for batch in batches:
        for part in tv.chunks(batch, "text"):
            doc, key, weight = bags(arrow_array(part, "text"))
            first, value = np.searchsorted(doc, np.arange(part.num_rows + 1)), packed(key, weight)
            yield pa.RecordBatch.from_arrays([arrow_array(part, "comp"), arrow_array(part, "id"), pa.array([value[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["comp", "id", "data"])


def _merged_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (comp, id, list of data): (comp, id, data), the weights of equal shingles added."""
    for batch in batches:
        data = []
        for parts in arrow_array(batch, "data").to_pylist():
            key, weight = unpacked(np.concatenate([np.frombuffer(x, np.int64) for x in parts]))
            key, at = np.unique(key, return_inverse=True)
            data.append(packed(key, np.bincount(at, weight, len(key)).astype(np.int64)).tobytes())
        yield pa.RecordBatch.from_arrays([arrow_array(batch, "comp"), arrow_array(batch, "id"), pa.array(data, pa.binary())], names=["comp", "id", "data"])


BAG = "comp bigint, id bigint, data binary"


def groups(docs: DataFrame, threshold: float = THRESHOLD, most_bytes: int = GROUP_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that belongs to a class of near copies; a written table."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    copies, several = equal_documents(docs)
    rest = without(docs, copies.select("doc_id"))
    comp = written(candidate_groups(rest, hot_rows=hot_rows).select(F.col("id").alias("__id"), "comp"))
    small = F.broadcast(comp) if comp.count() * 16 <= 32 << 20 else comp
    rows = rest.join(small, F.col("doc_id") == F.col("__id")).select("comp", F.col("__id").alias("id"), "text")
    bag = mapped(rows, _packed_bags, BAG)
    if not several.isEmpty():
        bag = written(bag)
        twice = bag.join(several.select(F.col("doc_id").alias("id")), "id", "left_semi").groupBy("comp", "id").agg(F.collect_list("data").alias("data"))
        bag = bag.join(several.select(F.col("doc_id").alias("id")), "id", "left_anti").select("comp", "id", "data").union(mapped(twice, _merged_bags, BAG))
    moved = written(clustered(bag, lambda v, off, a, b: overlap_pairs(v, off, a, b, threshold), lambda v, off, i, o: overlap_one(v, off, i, o, threshold), early_shingles, most_bytes))
    again = copies.join(moved.select(F.col("id").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("kept_doc_id"))
    both = written(moved.select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id")).union(again))
    drop(copies, several, comp, moved)
    return both.union(both.select(F.col("kept_doc_id").alias("doc_id"), "kept_doc_id").distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id, keep) of every document with an id; one outside any group keeps itself."""
    found = groups(docs, threshold)
    rest = without(docs.select("doc_id").filter("doc_id is not null").distinct(), written(found.select("doc_id")))
    return found.select("doc_id", "kept_doc_id", (F.col("doc_id") == F.col("kept_doc_id")).alias("keep")).union(rest.select("doc_id", F.col("doc_id").alias("kept_doc_id"), F.lit(True).alias("keep")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each group, all columns as they were."""
    gone = written(groups(docs, threshold).filter("doc_id <> kept_doc_id").select("doc_id"))
    return without(docs, gone)
