"""Retrieval accuracy: token-level correctness and the share of scenarios answered among the first k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _least_distance(p: list[str], e: list[str]) -> int:
    """Least Levenshtein distance of a window of p, as long as e, to e. All windows advance together."""
    n = len(e)
    starts = np.arange(max(len(p) - n, 0) + 1)
    m = min(len(p), n)
    code = {t: i for i, t in enumerate(e)}
    x = np.array([code.get(t, -1) for t in p], np.int64)
    y = [code[t] for t in e]
    row = np.repeat(np.arange(n + 1)[None, :], len(starts), 0)
    for i in range(m):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        same = x[starts + i]
        for j in range(n):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (same != y[j]))
        row = new
    return int(row[:, n].min())


def correctness(predicted: Column, expected: Column) -> Column:
    """100 * (1 - least token distance of a window of the prediction to what was expected / its length); 0 if nothing was expected, null if either is null."""

    def run(p: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else 100.0 * (1 - _least_distance(list(a), list(b)) / len(b)) if len(b) else 0.0 for a, b in zip(p, e, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(T.norm_tokens(T.tokens(predicted)), T.norm_tokens(T.tokens(expected)))


def accuracy(found: DataFrame, facts: DataFrame, ks: list[int], least: float = 70.0) -> DataFrame:
    """k and the share of queries in facts(query_id, fact) one of whose first k passages in found(query_id, rank, passage) is correct. A query without passages counts as wrong."""
    best = found.join(facts, "query_id").withColumn("c", correctness(F.col("passage"), F.col("fact"))).where(F.col("c") >= least).groupBy("query_id").agg(F.min("rank").alias("first"))
    each = facts.select("query_id").distinct().join(best, "query_id", "left").select("query_id", "first", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    return each.groupBy("k").agg(F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))).alias("accuracy"))


def noisy_query(context: Column, question: Column, speaker: Column, n: int = 40) -> Column:
    """The last tokens of up to three context lines and the question, each said by a speaker."""
    lines = F.transform(F.concat(F.slice(context, F.greatest(F.size(context) - 2, F.lit(1)), F.lit(3)), F.array(question)), lambda x: F.concat(speaker, F.lit(": "), x))
    return F.array_join(T.last_tokens(T.tokens(F.array_join(lines, "\n")), n), "")


def split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: the same rows every time, on any partitioning."""
    low = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.where(low), rows.where(~low)


def query_passage_pairs(docs: DataFrame, n_query: int = 12, max_gap: int = 12, n_passage: int = 24, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """A positive pair from each text, a span and one shortly after it, and a negative one with the passage of the next text in hash order of its bucket."""
    toks = F.filter(T.tokens(F.col("text")), lambda t: F.length(F.trim(t)) > 0)
    base = docs.select(F.col(id_col).alias("id"), toks.alias("t")).where(F.size("t") >= n_query + max_gap + n_passage)
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.size("t") - (n_query + max_gap + n_passage) + 1).cast("int") + 1
    gap = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(max_gap + 1)).cast("int")
    spans = base.select("id", F.array_join(F.slice("t", at, F.lit(n_query)), " ").alias("query"), F.array_join(F.slice("t", at + n_query + gap, F.lit(n_passage)), " ").alias("passage"))
    from pyspark.sql import Window

    w = Window.partitionBy(F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(1024))).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    other = spans.withColumn("other", F.lead("passage").over(w)).where("other is not null").select("id", "query", F.col("other").alias("passage"), F.lit(False).alias("match"))
    return spans.withColumn("match", F.lit(True)).unionByName(other)
