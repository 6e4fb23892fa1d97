"""Shared pieces: durable intermediate tables, bounded broadcasts, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quillstack.llm.textvec import mix
from quillstack.plans.store import drop, written

#: Bytes that may be sent to every worker; beyond it operators take a shuffle instead.
BROADCAST_BYTES = 64 << 20
#: Edges that one task may contract; beyond it the star algorithm runs distributed.
ONE_TASK_EDGES = 4_000_000

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the session did not ship it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def mapped(df: DataFrame, run: Run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(); after each partition the worker, which lives on, gives back the memory that it doesn't use."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(released, schema)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters it has."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def arrow_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def int_column(batch: pa.RecordBatch, name: str, null: int = np.iinfo(np.int64).min) -> np.ndarray:
    return arrow_array(batch, name).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: input sorted by keys, never split within a group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.zeros(batch.num_rows, bool)
        for key in keys:
            x = arrow_array(batch, key).to_numpy(zero_copy_only=False)
            ends[:-1] |= x[1:] != x[:-1]
        if rest:
            before = rest[-1].slice(rest[-1].num_rows - 1).to_pydict()
            first = batch.slice(0, 1).to_pydict()
            if any(before[k] != first[k] for k in keys):
                yield pa.Table.from_batches(rest)
                rest = []
        at = np.flatnonzero(ends)
        if len(at):
            yield pa.Table.from_batches([*rest, batch.slice(0, at[-1] + 1)])
            rest = [batch.slice(at[-1] + 1)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins, and the length."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of their component, by vectorised hooking and pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


EDGE = "a bigint, b bigint"


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of all batches, contracted to stars whenever as many new ones have come as are kept."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    new: list[pa.RecordBatch] = []
    have = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return contract(*(np.concatenate([x, *(int_column(batch, c) for batch in new)]) for x, c in ((a, "a"), (b, "b"))))

    for batch in batches:
        new.append(batch)
        have += batch.num_rows
        if have > max(1 << 16, len(a)):
            a, b = joined()
            new, have = [], 0
    a, b = joined()
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES, links: Run | None = None, more: DataFrame | None = None) -> DataFrame:
    """(id, comp) of every node of edges (a, b); comp is the least id it reaches. With links,
    the edges are what links makes of the rows of edges, in the same Python worker; more
    are further edges.

    Each partition first contracts its own edges to stars. If what is left fits
    one task it is contracted there; otherwise large-star and small-star rounds
    run until nothing changes, each round written to the shared folder.
    """
    edges = mapped(edges, lambda batches: _contract_batches(links(batches)), EDGE) if links else mapped(edges.select("a", "b"), _contract_batches, EDGE)
    edges = written(edges if more is None else edges.union(mapped(more, _contract_batches, EDGE)))
    if edges.count() <= one_task:
        out = mapped(edges.coalesce(1), _contract_batches, EDGE)
        return out.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    first = edges
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    seen = None
    while True:
        both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, written(small)
        if before is not first:
            drop(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(low, nodes.id == low.a, "left").select("id", F.coalesce("m", "id").alias("comp"))


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Components of n items by breadth-first search: near(i, others) tells which of
    others are linked to i. Each item is compared only with items not yet reached."""
    label = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        seed, left = left[0], left[1:]
        label[seed] = seed
        queue = [seed]
        while queue and len(left):
            hit = near(queue.pop(), left)
            if hit.any():
                label[left[hit]] = seed
                queue.extend(left[hit])
                left = left[~hit]
    return label


#: Rows of a bucket that are compared pair by pair; larger buckets are searched breadth first.
PAIRED_ROWS = 512


def bucket_links(linked: Callable[[np.ndarray, np.ndarray], np.ndarray], sketches: tuple[str, ...] = ("sketch",), quick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Run:
    """For mapInArrow over rows (key, id, sketches) sorted by key: star edges of the
    components, within a bucket or several, of the rows whose sketches are linked.
    linked compares arrays whose last axis is the sketch columns; quick, which must hold
    for all that are linked, compares the first column alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key"]):
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            use = np.flatnonzero(np.append(same, False) | np.append(False, same))  # most rows are alone with their key
            if not len(use):
                continue
            key, ids = key[use], table.column("id").to_numpy()[use]
            sketch = np.stack([table.column(c).to_numpy()[use] for c in sketches], 1)
            at = run_starts(key)
            size = np.diff(at)
            left = np.repeat(at[1:], size) - np.arange(len(key)) - 1  # rows of the bucket after each
            left[np.repeat(size > PAIRED_ROWS, size)] = 0
            a, b = [], []
            open_, lead = np.arange(len(key)), np.ascontiguousarray(sketch[:, 0])
            for step in range(1, PAIRED_ROWS):
                open_ = open_[left[open_] >= step]
                if not len(open_):
                    break
                i = open_ if quick is None else open_[quick(lead[open_], lead[open_ + step])]
                i = i[linked(sketch[i], sketch[i + step])]
                a.append(ids[i])
                b.append(ids[i + step])
            for s, k in zip(at[:-1][size > PAIRED_ROWS], size[size > PAIRED_ROWS], strict=True):
                i, x = ids[s : s + k], sketch[s : s + k]
                lab = spread(k, lambda p, o, x=x: linked(x[p], x[o]))
                a.append(i[lab])
                b.append(i)
            if not a:
                continue
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = contract(a[a != b], b[a != b])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return run


#: Bytes of a candidate group that one task clusters; larger groups are cut up.
GROUP_BYTES = 16 << 20
Pairs = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
One = Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]
Keys = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def binary_items(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int64 values of a binary column, one after another, and each row's first one."""
    whole = column.cast(pa.large_binary())
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
        whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    off = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8) // 8
    data = whole.buffers()[2]
    return np.frombuffer(data, np.int64) if data is not None and data.size else np.zeros(0, np.int64), off


def _labelled(pairs: Pairs, one: One) -> Run:
    """For mapInArrow over (comp, chunk, id, data) sorted so: (comp, id, root), the least id linked to each within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["comp", "chunk"]):
            comp, chunk, ids = (table.column(c).to_numpy() for c in ("comp", "chunk", "id"))
            value, off = binary_items(table.column("data"))
            at = run_starts(comp, chunk)
            size = np.diff(at)
            root = ids.copy()
            two = at[:-1][size == 2]
            two = two[pairs(value, off, two, two + 1)]
            root[two + 1] = ids[two]
            for s, k in zip(at[:-1][size > 2], size[size > 2], strict=True):
                root[s : s + k] = ids[s + spread(k, lambda i, o, s=s: one(value, off, s + i, s + o))]
            yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array(ids), pa.array(root)], names=["comp", "id", "root"])

    return run


LABELS = "comp bigint, id bigint, root bigint"


def clustered(rows: DataFrame, pairs: Pairs, one: One, keys: Keys, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, root) of the rows (comp, id, data) whose root, the least id of their class, is another:
    rows of a candidate group comp are of a class if links join them. pairs and one say which
    rows are linked, from the int64 values of data; keys gives (row, key), as uint64, such that
    linked rows have a key in common.

    A group of more than most_bytes is cut into chunks by hash of the id, and each task
    clusters a chunk. Of what is left of the group, one row for each class of a chunk, the
    same is done again. Links that may remain lie between rows one of which isn't in the
    group's largest class: these travel, most_bytes at a time, to all rows of their group, where
    they meet those with a common key.
    """
    spark = rows.sparkSession
    table = written(rows.select("comp", "id", "data"))
    weight = F.length("data") + 64
    large = table.groupBy("comp").agg(F.sum(weight).alias("bytes")).filter(F.col("bytes") > most_bytes)
    large = written(large.select("comp", F.ceil(F.col("bytes") / most_bytes).alias("chunks")))
    few = F.broadcast(large) if large.count() * 16 <= BROADCAST_BYTES else large
    cut = table.join(few, "comp", "left").select("comp", F.coalesce(F.pmod(F.xxhash64("id"), "chunks"), F.lit(0)).alias("chunk"), "id", "data")
    labels = written(mapped(cut.repartition("comp", "chunk").sortWithinPartitions("comp", "chunk", "id"), _labelled(pairs, one), LABELS))
    if large.isEmpty():
        drop(table, large)
        return labels.filter("id <> root").select("id", "root")
    mine = table.join(few, "comp", "left_semi").join(labels.select("id", "root"), "id")
    reps = written(mine.filter("id = root").select("comp", "id", "data"))
    if 2 * reps.count() <= mine.count():
        up = written(clustered(reps, pairs, one, keys, most_bytes))
        labels = written(labels.join(up.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("comp", "id", F.coalesce("top", "root").alias("root")))
        mine = table.join(few, "comp", "left_semi").join(labels.select("id", "root"), "id")
    mine = written(mine.select("comp", "id", "root", "data"))  # every pass reads it
    held = mine.groupBy("comp", "root").agg(F.count("*").alias("n"))
    main = held.groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    others = written(mine.join(main, "comp").filter("root <> main").select("comp", "id", "root", "data"))
    total = others.agg(F.sum(weight)).first()[0] or 0
    waves = -(-total // most_bytes)
    edges = spark.createDataFrame([], EDGE)
    for wave in range(waves):
        some = others.filter(F.pmod(F.xxhash64("id", F.lit("wave")), F.lit(waves)) == wave).toArrow().sort_by([("comp", "ascending"), ("id", "ascending")])
        if some.num_rows:
            edges = edges.union(written(mapped(mine, _across(spark.sparkContext.broadcast(_indexed(some, keys)), pairs, keys), EDGE)))
    top = written(connected_components(edges))
    drop(mine)
    return labels.join(top.select(F.col("id").alias("root"), F.col("comp").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")).filter("id <> root")


#: Pairs that are looked at together.
PAIRS_AT_ONCE = 1 << 18


def _indexed(some: pa.Table, keys: Keys) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows (comp, id, root, data), the keys of all with their groups, sorted, and the row that each is of: made once, not by every task."""
    owner, key = keys(*binary_items(some.column("data")))
    key = mix(key ^ mix(some.column("comp").to_numpy()[owner].view(np.uint64)))
    order = np.argsort(key, kind="stable")
    return some, key[order], owner[order].astype(np.int32)


def _across(sent, pairs: Pairs, keys: Keys) -> Run:
    """For mapInArrow over (comp, id, root, data): edges between the classes of rows and of linked rows that were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, key, owner = sent.value
        comp, root = there.column("comp").to_numpy(), there.column("root").to_numpy()
        value, off = binary_items(there.column("data"))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def top(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(a, x), len(a) - 1)
            return np.where(a[at] == x, b[at], x) if len(a) else x

        for batch in batches:
            mine, more = binary_items(pa.Table.from_batches([batch]).column("data"))
            v, o = np.concatenate([value, mine]), np.append(off, more[1:] - more[0] + off[-1])
            its_comp, its_root = int_column(batch, "comp"), int_column(batch, "root")
            row, sought = keys(mine, more - more[0])
            sought = mix(sought ^ mix(its_comp[row].view(np.uint64)))
            lo = np.searchsorted(key, sought)
            size = np.searchsorted(key, sought, "right") - lo
            begin = np.append(0, np.cumsum(size))
            s = 0
            while s < len(row):  # rows of keys with about so many pairs
                e = max(s + 1, int(np.searchsorted(begin, begin[s] + PAIRS_AT_ONCE, "right")) - 1)
                n = size[s:e]
                other = owner[np.arange(n.sum()) + np.repeat(lo[s:e] - np.cumsum(n) + n, n)]
                pair = np.unique(np.repeat(row[s:e], n) * len(comp) + other)
                i, j = pair // len(comp), pair % len(comp)
                apart = (its_comp[i] == comp[j]) & (top(its_root[i]) != top(root[j]))
                i, j = i[apart], j[apart]
                hit = pairs(v, o, len(comp) + i, j)
                if hit.any():
                    a, b = contract(np.append(a, its_root[i[hit]]), np.append(b, root[j[hit]]))
                s = e
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


#: One in so many rows is counted to find keys that many rows have, and rows of a bucket beyond which its key is such.
SAMPLED, HOT_ROWS = 64, 1 << 16


def hot_keys(keys: DataFrame, least: int, limit: int = BROADCAST_BYTES) -> np.ndarray:
    """The keys that at least so many of the rows (key) have, sorted, or a greater number if they would pass the limit.
    It decides only by which of two ways a key's rows meet, not whether they do."""
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    while counts.filter(F.col("n") >= least).count() * 8 > limit:
        least *= 2
    out = np.sort(counts.filter(F.col("n") >= least).select("key").toArrow().column(0).to_numpy())
    drop(counts)
    return out


def inside(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def collected(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> pa.Table | None:
    """The rows of a written table if they fit the broadcast limit, else None."""
    return None if df.count() * row_bytes > limit else df.toArrow()


def matching(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id, the places of it in sorted_ids: (index of the id, place), flat."""
    lo, hi = np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, "right")
    size = hi - lo
    return np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)


def list_rows(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of the row of each element of a list column, and the elements; null lists have none."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten()


def keep_masked(docs: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows of docs where mask is true, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return mapped(docs, run, docs.schema)


def without(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the doc_ids in the written one-column table ids; null ids stay."""
    rows = collected(ids, 8, limit)
    if rows is None:
        return docs.join(ids.toDF("doc_id"), "doc_id", "left_anti").select(columns_of(docs))
    drop = docs.sparkSession.sparkContext.broadcast(np.unique(rows.column(0).to_numpy()))

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        x = arrow_array(batch, "doc_id")
        hit = np.isin(x.fill_null(-1).to_numpy(zero_copy_only=False), drop.value)
        return ~hit | x.is_null().to_numpy(zero_copy_only=False)

    return keep_masked(docs, mask)
