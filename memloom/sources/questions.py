"""Question sources, what they say as scenarios and facts, and samples of query and passage.

Samples are drawn by the digest of a seed and a key, so a sample is the same on every cluster and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def draw(seed: int, *key: Column | str) -> Column:
    """A digest that orders rows at random."""
    return F.md5(F.concat_ws("-", F.lit(seed).cast("string"), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)).cast("binary"))


def fraction(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) by the digest."""
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def first_n(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in random order."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows."""
    train = fraction(seed, key) < share
    return rows.where(train), rows.where(~train)


def question_answers(rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Rows with an answer, of some kinds of source."""
    out = rows.where("answer is not null and answer <> ''")
    return out.where(F.col("source").isin(kinds)) if kinds else out


def tagged(rows: DataFrame, dataset: str, key: str) -> DataFrame:
    """Rows with the data set's name and a row number in order of the key, valid rows only."""
    valid = rows.where(f"{key} is not null")
    return valid.withColumn("dataset", F.lit(dataset)).withColumn("row_id", F.row_number().over(Window.partitionBy("dataset").orderBy(key)))


def rewritten_scenarios(rows: DataFrame, use_rewrite: bool = False) -> DataFrame:
    """context, facts and question of rows(id, question, rewrite, answer, context[]) that have all three."""
    q = F.col("rewrite" if use_rewrite else "question")
    return rows.where((F.col("answer") != "") & F.col("context").isNotNull() & (q != "")).select("id", "context", F.array("answer").alias("facts"), q.alias("question"))


def strategy_scenarios(rows: DataFrame, most: int = 1) -> DataFrame:
    """The same of rows(id, question, description, facts[]): the description is the context, the first facts support."""
    ok = (F.size("facts") > 0) & (F.col("question") != "")
    return rows.where(ok).select("id", F.array(F.coalesce("description", F.lit(""))).alias("context"), F.slice("facts", 1, most).alias("facts"), "question")


def stored_facts(scenarios: DataFrame) -> DataFrame:
    """A row for each fact that a memory is to store."""
    return scenarios.select("id", F.posexplode("facts").alias("n", "fact"))


def queries_and_support(scenarios: DataFrame) -> DataFrame:
    return scenarios.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.col("facts").alias("support"))


_EVALUATORS: dict[str, Callable[..., DataFrame]] = {"rewritten": rewritten_scenarios, "strategy": strategy_scenarios}


def evaluator(name: str) -> Callable[..., DataFrame]:
    """Scenarios of a kind of data set; ValueError for an unknown one."""
    if name not in _EVALUATORS:
        raise ValueError(f"no evaluator {name}: {', '.join(_EVALUATORS)}")
    return _EVALUATORS[name]


def snapped_start(toks: Column, start: Column, leeway: int, stops: list[str] | None = None) -> Column:
    """Where a passage with an answer at token `start` begins: after the last sentence end of the `leeway` tokens before it, or that far back."""
    lo = F.greatest(start - leeway, F.lit(0))
    before = F.slice(toks, lo + 1, start - lo)
    marks = F.array(*(F.lit(s) for s in (stops or T.punctuation())))
    hit = F.array_max(F.transform(before, lambda t, i: F.when(F.array_contains(marks, t), i + 1)))
    return lo + F.coalesce(hit, F.lit(0))


def negatives(entries: DataFrame, key: str, seed: int, other_share: float = 0.5) -> DataFrame:
    """entries with other: the entry a negative passage comes from, one drawn at random, or, for the rest, the same.

    The drawn one is the next in an order of digests, cut into groups of about a thousand by the digest, so no
    task sees all rows. Of a group of one, the entry itself.
    """
    g = Window.partitionBy("__g").orderBy("__d", key)
    rows = entries.select(key, draw(seed, key).alias("__d"))
    n = F.lit(max(1, rows.count() // 1000))
    rows = rows.withColumn("__g", F.pmod(F.conv(F.substring("__d", 1, 8), 16, 10).cast("long"), n))
    rows = rows.withColumn("__next", F.coalesce(F.lead(key).over(g), F.first(key).over(Window.partitionBy("__g").orderBy("__d", key))))
    other = F.when(fraction(seed + 1, key) < other_share, F.col("__next")).otherwise(F.col(key))
    return entries.join(rows.select(key, other.alias("other")), key)


def negative_start(n_tokens: Column, answer: Column, size: int, most: int, same: Column, chance: Column) -> Column:
    """Start of a passage of `size` tokens: away from the answer by `most` on its longer side in the same entry, anywhere in another; null without room."""
    right, left = n_tokens - (answer + most), answer - most
    lo = F.when(~same, 0).when(right >= left, answer + most).otherwise(0)
    hi = F.when(~same, n_tokens - size + 1).when(right >= left, n_tokens - size + 1).otherwise(answer - most - size + 1)
    return F.when(hi > lo, lo + F.floor(chance * (hi - lo)))


def sample_indexes(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys at random; each once, unless there are fewer: then as often as it takes."""
    total = keys.count()
    if not total:
        return keys.select(key)
    rounds = -(-n // total)
    many = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("__round"))
    return many.orderBy("__round", draw(seed, key), key).limit(n).select(key)


def weighted(sources: dict[str, tuple[DataFrame, float]], n: int, key: str, seed: int) -> DataFrame:
    """n rows of several sources in proportion to their weights (rounded), tagged with the source's name."""
    total = sum(w for _, w in sources.values())
    parts = [first_n(df, key, round(n * w / total), seed).withColumn("source_name", F.lit(name)) for name, (df, w) in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wrapped(toks: Column, begin: str, end: str) -> Column:
    """Tokens between a begin and an end token."""
    return F.concat(F.array(F.lit(begin)), toks, F.array(F.lit(end)))


def names(table: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Names of at most so many characters, numbered from 0; a small table."""
    w = Window.orderBy(name)
    return table.where(F.length(name) <= most).select(name).distinct().withColumn("n", F.row_number().over(w) - 1)


def named(rows: DataFrame, key: str, numbered: DataFrame, seed: int, broadcast_most: int = 1_000_000) -> DataFrame:
    """rows with a name each, drawn from a numbered table that is broadcast where its size allows."""
    n = numbered.count()
    pick = F.floor(fraction(seed, key) * n).cast("int").alias("n")
    small = F.broadcast(numbered) if n <= broadcast_most else numbered
    return rows.select("*", pick).join(small, "n").drop("n")


def speaker_query(rows: DataFrame, n_tokens: int = 40) -> DataFrame:
    """rows(id, context[], question, name) with query: the last three context lines and the name's question, its last tokens."""
    lines = F.slice("context", F.greatest(F.size("context") - 2, F.lit(1)), 3)
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"), F.col("name"), F.lit(": "), F.col("question"))
    return rows.withColumn("query", F.array_join(T.last_tokens(T.tokens(text), n_tokens), ""))
