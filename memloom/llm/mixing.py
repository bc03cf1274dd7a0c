"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its token share to the power ``alpha``, normalised: 1 keeps the shares, 0 makes
them equal. ``alpha`` is bisected: the largest that reaches the target entropy, or, where that repeats
a source more often than the limit, the smallest that meets the limit. The weights become budgets of
tokens, and budgets become epochs of permuted blocks of documents: whole epochs, and of the last one the
blocks, then the documents of one block, that fit.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

ENTROPY, MAX_REPEAT, BLOCK_TOKENS, SEED = 0.95, 2.0, 1 << 20, 4
MAX_BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text_col: str):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def bisect_alpha(shares: DataFrame, entropy: float, max_repeat: float, rounds: int = 8) -> float:
    """Alpha for shares(q): a row for each source with tokens. Each round splits the interval in 16, one aggregate."""

    def section(ok, lo: float, hi: float, keep_low: bool) -> float:
        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / 16 for i in range(17)]
            rows = shares.select("q", F.explode(F.array(*(F.lit(a) for a in grid))).alias("a")).groupBy("a").agg(F.sum(F.pow("q", "a")).alias("z"), F.sum(F.pow("q", "a") * F.col("a") * F.log("q")).alias("s"), F.min("q").alias("least"), F.max("q").alias("most")).collect()
            good = sorted(r["a"] for r in rows if ok(r))
            if not good:
                return lo if keep_low else hi
            if keep_low:
                lo = good[-1]
                hi = min([a for a in grid if a > lo], default=hi)
            else:
                hi = good[0]
                lo = max([a for a in grid if a < hi], default=lo)
            if lo == hi:
                break
        return lo if keep_low else hi

    n = shares.count()
    if n < 2:
        return 1.0
    alpha = section(lambda r: log(r["z"]) - r["s"] / r["z"] >= entropy * log(n) - 1e-12, 0.0, 1.0, True)
    # A source is repeated (largest share / its share) ** (1 - alpha) times where the largest is used once.
    return max(alpha, section(lambda r: (r["most"] / r["least"]) ** (1 - r["a"]) <= max_repeat, 0.0, 1.0, False))


def mix(docs: DataFrame, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """docs, each row as often as its source's budget takes it, with the plan's columns.

    mix_tokens: the row's words, or tokens_col; mix_alpha, mix_weight: its source's; mix_epoch: from 0;
    mix_block, mix_block_order, mix_order: its block, and the keys that order blocks and rows of an
    epoch. They take the place of columns of those names. total_tokens None is the smallest total that
    uses every row at least once. A budget is exceeded by less than one row. Null sources are a source
    of their own. Rows without tokens come in each whole epoch, and in the first. Rows that repeat an id
    count each. An empty table gives an empty result.
    """
    extra = ["mix_tokens", "mix_alpha", "mix_weight", "mix_epoch", "mix_block", "mix_block_order", "mix_order"]
    names = [c for c in docs.columns if c not in extra]
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    tokens = F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)).cast("long"), F.lit(0)) if tokens_col else count_words(text_col)
    rows = docs.select(*names, tokens.alias("mix_tokens"), key.alias("__source"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("__h"))
    narrow = scratch.save(rows.select("__source", "mix_tokens", "__h"), "mix-sizes")
    sources = scratch.save(narrow.groupBy("__source").agg(F.sum("mix_tokens").alias("t")), "mix-sources")
    total, n_sources = sources.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count("t")).first()
    q = F.col("t") / F.lit(float(total or 1))
    shares = sources.where("t > 0").select(q.alias("q"))
    alpha = bisect_alpha(shares, entropy, max_repeat)
    z, least_scale = shares.agg(F.sum(F.pow("q", F.lit(alpha))), F.max(F.pow("q", F.lit(1 - alpha)))).first()
    z, least_scale = z or 1.0, least_scale or 1.0
    wanted = float(total_tokens) if total_tokens is not None else total * z * least_scale
    plan = sources.withColumn("mix_weight", F.when(F.col("t") > 0, F.pow(q, F.lit(alpha)) / F.lit(z)).otherwise(0.0))
    plan = plan.withColumn("__budget", F.round(F.col("mix_weight") * F.lit(wanted)).cast("long"))
    plan = plan.select(
        "__source",
        "mix_weight",
        F.ceil(F.greatest(F.col("t"), F.lit(1)) / F.lit(block_tokens)).cast("long").alias("__blocks"),
        F.when(F.col("t") > 0, F.expr("__budget div t")).otherwise(1).cast("int").alias("__full"),
        F.when(F.col("t") > 0, F.expr("__budget % t")).otherwise(0).alias("__rest"),
    )
    if n_sources <= MAX_BROADCAST:
        plan = F.broadcast(plan)
    block = F.pmod(F.xxhash64(F.col("__h")), F.col("__blocks"))
    block_order = F.xxhash64(F.lit(seed), F.col("__source"), F.col("mix_epoch"), F.col("mix_block"))
    order = F.xxhash64(F.lit(seed), F.col("mix_epoch"), F.col("__h"))

    # The last, partial epoch: blocks in order until the rest is used; within the block where it ends, rows.
    last = narrow.join(plan, "__source").where("__rest > 0").withColumn("mix_block", block).withColumn("mix_epoch", F.col("__full"))
    blocks = last.groupBy("__source", "mix_block", "mix_epoch", "__rest").agg(F.sum("mix_tokens").alias("size"))
    run = Window.partitionBy("__source").orderBy(block_order, "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).where("before < __rest")
    blocks = scratch.save(blocks.select("__source", "mix_block", (F.col("__rest") - F.col("before")).alias("room"), "size"), "mix-blocks")
    part = last.join(blocks.where("size > room"), ["__source", "mix_block"]).groupBy("__source", "mix_block", "room", order.alias("o"), "__h").agg(F.sum("mix_tokens").alias("size"), F.count("__h").alias("copies"))
    fit = Window.partitionBy("__source", "mix_block").orderBy("o", "__h")
    # Rows of one id stand together: those of the last id that fits stay together, too.
    part = part.withColumn("before", F.sum("size").over(fit) - F.col("size")).where("before < room").groupBy("__source", "mix_block").agg(F.max(F.struct("o", "__h")).alias("__end"))
    ends = blocks.select("__source", "mix_block", (F.col("size") > F.col("room")).alias("__cut")).join(part, ["__source", "mix_block"], "left").where("not __cut or __end is not null")

    rows = rows.join(plan, "__source").withColumn("mix_block", block)
    whole = rows.where("__full > 0 or mix_tokens = 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__full") - 1, F.lit(0)))))
    rest = rows.where("__rest > 0 and not (__full = 0 and mix_tokens = 0)").withColumn("mix_epoch", F.col("__full")).join(ends, ["__source", "mix_block"])
    rest = rest.where(~F.col("__cut") | (F.struct(order.alias("o"), F.col("__h").alias("__h")) <= F.col("__end")))
    out = whole.unionByName(rest.drop("__cut", "__end"))
    out = out.withColumn("mix_block_order", block_order).withColumn("mix_order", order).withColumn("mix_alpha", F.lit(alpha))
    return out.select(*names, *extra)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    docs = docs.select("doc_id", "source", count_words("text").alias("n_tokens"))
    return mix(docs, tokens_col="n_tokens").drop("n_tokens")
