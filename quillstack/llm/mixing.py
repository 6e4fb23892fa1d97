"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its doc_id in [0, 2**40). Tokens are summed by source
and by the hash's leading bits; cumulative sums give, for each budget, the bucket
in which it is used up; only the documents of that bucket are then looked at to
find the exact threshold. A document is in a budget if its hash is at or below the
threshold, so budgets are nested and selection is a filter, without a sort.

A source takes documents in hash order while their cumulative tokens stay within
its budget; documents of equal hash (the same doc_id) enter together or not at all.
Tokens are runs of characters other than white space. Target weights default to
tokens ** temperature over sources; the largest budget is the most for which no
source has too few tokens for its weight, and the others are fractions of it.

Defined cases: null and empty text have no tokens, very long ones all that they have.
A null source is a source of its own. A null doc_id hashes as the empty string. Rows
with the same doc_id tie in hash and enter together. Sources without tokens, or without
a weight, are left out. An empty table gives none. Other columns, whatever their names,
are untouched. Sources are taken to be few enough to list on the driver; so many that
their thresholds pass the broadcast bound are joined by a shuffle.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quillstack.llm.common import BROADCAST_BYTES, columns_of, drop, fresh, prepare, written

TEMPERATURE = 0.7
FRACTIONS = (0.25, 0.5, 1.0)
HASH_BITS, BUCKET_BITS = 40, 10


def doc_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, n_tokens), written once: the only pass over the texts."""
    prepare(docs.sparkSession)
    return written(docs.select("doc_id", "source", doc_hash(F.col("doc_id")).alias("h"), token_count(F.col("text")).alias("n_tokens")))


def thresholds(rows: DataFrame, weights: dict[str | None, float] | None = None, fractions: tuple[float, ...] = FRACTIONS, temperature: float = TEMPERATURE) -> list[tuple[str | None, int, float, int]]:
    """(source, tier, budget, threshold): the greatest hash in the budget, -1 if none. As many rows as sources times fractions."""
    spark = rows.sparkSession
    shift = HASH_BITS - BUCKET_BITS
    bucket = F.shiftright("h", shift)
    hist = written(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n")))
    total = {r[0]: r[1] for r in hist.groupBy("source").agg(F.sum("n")).collect() if r[1]}
    goal = {s: float(weights.get(s, 0)) if weights is not None else float(n) ** temperature for s, n in total.items()}
    goal = {s: g for s, g in goal.items() if g > 0}
    if not goal:
        return []
    most = min(total[s] / g for s, g in goal.items())
    budgets = [(s, k, f * most * g if f * most * g < total[s] * (1 - 1e-12) else float(total[s])) for s, g in goal.items() for k, f in enumerate(sorted(fractions))]
    b = _small(spark.createDataFrame(budgets, "b_source string, tier int, budget double"), len(budgets))
    run = F.sum("n").over(W.partitionBy("source").orderBy("bucket"))
    full = hist.select("source", "bucket", (run - F.col("n")).alias("before"), run.alias("upto"))
    edge = full.join(b, F.col("source").eqNullSafe(F.col("b_source"))).filter("budget < upto and budget >= before")
    edge = _small(edge.select(F.col("b_source"), "tier", "budget", "bucket", "before"), len(budgets))
    inside = rows.withColumn("r_bucket", bucket).join(edge, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("r_bucket") == F.col("bucket")))
    upto = F.col("before") + F.sum("n_tokens").over(W.partitionBy("b_source", "tier").orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = inside.select("b_source", "tier", "bucket", "budget", "h", upto.alias("upto")).groupBy("b_source", "tier", "bucket").agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("h"))).alias("h"))
    found = {(r[0], r[1]): r[3] if r[3] is not None else (r[2] << shift) - 1 for r in last.collect()}
    drop(hist)
    return [(s, k, x, found.get((s, k), (1 << HASH_BITS) - 1)) for s, k, x in budgets]


def _small(df: DataFrame, n_rows: int) -> DataFrame:
    """df for a broadcast, if its rows, one or a few a source, are as few as they usually are."""
    return F.broadcast(df) if n_rows * 256 <= BROADCAST_BYTES else df


def _with_tier(df: DataFrame, cut: list[tuple[str | None, int, float, int]], h: Column, tier: str) -> DataFrame:
    """df's rows that a budget holds, with the first such budget in the column tier."""
    by: dict[str | None, list[int]] = {}
    for s, _, _, limit in sorted(cut, key=lambda c: c[1]):
        by.setdefault(s, []).append(limit)
    own, limits, hashed = (fresh(df, x) for x in ("mix_source", "mix_limits", "mix_hash"))
    table = df.sparkSession.createDataFrame([(s, x) for s, x in by.items()], T.StructType([T.StructField(own, T.StringType()), T.StructField(limits, T.ArrayType(T.LongType()))]))
    joined = df.withColumn(hashed, h).join(_small(table, len(by)), df["source"].eqNullSafe(F.col(own)))
    out = joined.filter(F.col(hashed) <= F.array_max(limits))
    return out.withColumn(tier, F.size(F.filter(limits, lambda x: x < F.col(hashed))))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, fractions: tuple[float, ...] = FRACTIONS, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, source, n_tokens, tier) of the documents within the largest budget."""
    rows = measured(docs)
    cut = thresholds(rows, weights, fractions, temperature)
    return _with_tier(rows, cut, F.col("h"), "tier").select("doc_id", "source", "n_tokens", "tier")


def select_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of docs within the largest budget, all columns as they were."""
    rows = measured(docs)
    cut = thresholds(rows, weights, (1.0,), temperature)
    drop(rows)
    return _with_tier(docs, cut, doc_hash(docs["doc_id"]), fresh(docs, "mix_tier")).select(columns_of(docs))


def check_nested(cut: list[tuple[str | None, int, float, int]]) -> bool:
    """Whether each source's thresholds rise with the budget."""
    by: dict[str | None, list[int]] = {}
    for s, k, _, limit in sorted(cut, key=lambda c: (str(c[0]), c[1])):
        by.setdefault(s, []).append(limit)
    return all(a <= b for x in by.values() for a, b in pairwise(x))


ORACLE_SQL = r"""
WITH m AS (SELECT doc_id, source, CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10)) AS BIGINT) AS h,
                  CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^ \t\n\x0B\f\r]+', 'x', 'g'), '[ \t\n\x0B\f\r]', '', 'g')), 0) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS total FROM m GROUP BY source HAVING sum(n_tokens) > 0),
g AS (SELECT source, total, pow(total, 0.7) AS g FROM t),
b AS (SELECT source, tier, CASE WHEN f * most * g < total * (1 - 1e-12) THEN f * most * g ELSE total END AS budget
      FROM g, (SELECT min(total / g) AS most FROM g), (VALUES (0, 0.25), (1, 0.5), (2, 1.0)) AS fr(tier, f)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY h) AS upto FROM m)
SELECT c.doc_id, c.source, c.n_tokens, CAST(min(b.tier) AS INTEGER) AS tier
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.upto <= b.budget
GROUP BY ALL
"""
