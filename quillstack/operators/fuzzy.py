"""Typo-tolerant expansion of query tokens: vocabulary terms at edit distance one."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

_LETTERS = string.ascii_lowercase + string.digits


@dataclass(frozen=True)
class FuzzyOptions:
    enabled: bool = False
    max_edits: int = 1
    df_threshold: int = 5
    min_token_len: int = 4
    max_candidates: int = 50


def neighborhood(token: str) -> list[str]:
    """Every string one deletion, substitution or insertion away, repeats included."""
    cuts = [(token[:i], token[i:]) for i in range(len(token) + 1)]
    out = [a + b[1:] for a, b in cuts if b]
    out += [a + c + b[1:] for a, b in cuts if b for c in _LETTERS if c != b[0]]
    return out + [a + c + b for a, b in cuts for c in _LETTERS]


def eligible(terms: DataFrame, stats: DataFrame, tokens: list[str], options: FuzzyOptions) -> DataFrame:
    """(corpus_id, q) of the distinct query tokens that may be expanded: long enough and rare, or absent."""
    use = [t for t in dict.fromkeys(tokens) if options.enabled and options.max_edits == 1 and len(t) >= options.min_token_len]
    q = F.explode(F.array(*[F.lit(t) for t in use]).cast("array<string>")).alias("q")
    known = terms.filter(F.col("token").isin(use)).select("corpus_id", F.col("token").alias("q"), "df")
    return stats.select("corpus_id", q).join(known, ["corpus_id", "q"], "left").filter(F.coalesce("df", F.lit(0)) < options.df_threshold).select("corpus_id", "q")


def candidates(terms: DataFrame, stats: DataFrame, tokens: list[str], options: FuzzyOptions) -> DataFrame:
    """(corpus_id, q, token, place): the first terms, in order, at distance exactly one.
    Query tokens are literals: the vocabulary is read once and no side is shuffled to join."""
    use = [t for t in dict.fromkeys(tokens) if options.enabled and options.max_edits == 1 and len(t) >= options.min_token_len]
    near = F.array_compact(F.array(*[F.when((F.abs(F.length("token") - len(t)) <= 1) & (F.levenshtein("token", F.lit(t), 1) == 1), F.lit(t)) for t in use]).cast("array<string>"))
    found = terms.select("corpus_id", "token", F.explode(near).alias("q")).join(eligible(terms, stats, tokens, options), ["corpus_id", "q"], "left_semi")
    place = F.row_number().over(W.partitionBy("corpus_id", "q").orderBy("token"))
    return found.withColumn("place", place).filter(F.col("place") <= options.max_candidates).select("corpus_id", "q", "token", "place")


def expansion(terms: DataFrame, stats: DataFrame, tokens: list[str], options: FuzzyOptions) -> DataFrame:
    """(corpus_id, q, token, place): the terms that stand for each query token; place 0 is the token itself."""
    distinct = list(dict.fromkeys(tokens))
    exact = terms.filter(F.col("token").isin(distinct)).select("corpus_id", F.col("token").alias("q"), "token", F.lit(0).alias("place"))
    return exact.union(candidates(terms, stats, tokens, options)) if options.enabled else exact
