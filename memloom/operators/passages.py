"""Expansion of chunks to passages, and greedy removal of overlapping ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Expansion
from ..functions import text as T

#: Chunks of an Arrow batch, about; and a place for each row of it, wider than a text.
BATCH, WIDE = 1 << 18, 1 << 40


def stops_of(expansion: Expansion) -> list[list[str]]:
    """The tokens of each stop of the expansion's limit."""
    return [re.findall(r"\s|\w+|[^\w\s]", s) for s in expansion.limit.value]


def _stops(arr: Column, stops: list[list[str]], last: bool) -> Column:
    """Length to cut: through the last stop of arr, or through the first. Null without one. The earliest or latest start counts, then the first stop."""

    def ends(s: list[str]) -> Column:
        n = len(s)
        if n == 1:  # a native search
            at = F.when(F.array_contains(arr, s[0]), F.size(arr) + 1 - F.array_position(F.reverse(arr), s[0]) if last else F.array_position(arr, s[0])).cast("int")
            return F.when(at.isNotNull(), F.struct(at.alias("at"), at.alias("end")))
        hits = F.filter(F.sequence(F.lit(1), F.size(arr) - n + 1), lambda i: F.slice(arr, i, F.lit(n)) == F.array(*(F.lit(t) for t in s)))
        hits = F.when(F.size(arr) >= n, hits).otherwise(F.array().cast("array<int>"))
        at = F.array_max(hits) if last else F.array_min(hits)
        return F.when(at.isNotNull(), F.struct(at.alias("at"), (at + (n - 1)).alias("end")))

    found = F.filter(F.array(*(ends(s) for s in stops)), lambda x: x.isNotNull())
    return (F.array_max(found) if last else F.array_min(found))["end"]


def expand(hits: DataFrame, tiles: DataFrame, expansion: Expansion, stride: int, stop_tokens: list[list[str]] | None = None, few: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """hits with p_from, p_to, p_tokens and passage of the expanded chunk.

    hits: mem_id, section_id, from_seq, to_seq, section_from, section_to, first_seq. tiles: the chunks, of which
    the first `stride` tokens of each make the section again; a passage joins the few it covers by key.
    few: broadcasts the hits where the caller knows that they are few, so the tiles stay where they are.
    """
    if stop_tokens is None:
        stop_tokens = stops_of(expansion)
    lo = F.greatest("section_from", "first_seq")
    h = hits
    h = h.withColumn("__a", F.greatest(F.col("from_seq") - expansion.least, lo)).withColumn("__b", F.least(F.col("to_seq") + expansion.least, F.col("section_to")))
    h = h.withColumn("__lo", F.greatest(F.col("from_seq") - expansion.most, lo)).withColumn("__hi", F.least(F.col("to_seq") + expansion.most, F.col("section_to")))
    need = h.select(*hits.columns, "__a", "__b", "__lo", "__hi", F.explode(F.sequence(F.floor((F.col("__lo") - F.col("section_from")) / stride), F.floor((F.col("__hi") - 1 - F.col("section_from")) / stride))).alias("chunk_no_"))
    t = tiles.select("mem_id", "section_id", F.col("chunk_no").alias("chunk_no_"), F.slice("tokens", 1, stride).alias("__tile"))
    # A hit is its chunk and query; its other columns follow from those.
    keys = [c for c in ("query_id", "mem_id", "section_id", "chunk_no", "chunk_id") if c in hits.columns]
    if not {"chunk_no", "chunk_id"} & set(keys):
        keys = [c for c in hits.columns if not dict(hits.dtypes)[c].startswith("map")]
    rest = [c for c in [*hits.columns, "__a", "__b", "__lo", "__hi"] if c not in keys]
    got = few(need).join(t, ["mem_id", "section_id", "chunk_no_"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_no_", "__tile"))).alias("__tiles"), *(F.first(c).alias(c) for c in rest))
    offset = F.col("section_from") + F.element_at("__tiles", 1)["chunk_no_"] * stride
    all_ = F.flatten(F.transform("__tiles", lambda x: x["__tile"]))
    got = got.withColumn("__all", all_).withColumn("__off", offset)

    def cut(a: str, b: str) -> Column:
        return F.slice("__all", (F.col(a) - F.col("__off") + 1).cast("int"), F.greatest(F.col(b) - F.col(a), F.lit(0)).cast("int"))

    got = got.withColumn("__left", cut("__lo", "__a")).withColumn("__mid", cut("__a", "__b")).withColumn("__right", cut("__b", "__hi"))
    if stop_tokens:
        k = F.coalesce(_stops(F.col("__left"), stop_tokens, True), F.lit(0))
        m = F.coalesce(_stops(F.col("__right"), stop_tokens, False), F.size("__right"))
        got = got.withColumn("__left", F.slice("__left", k + 1, F.greatest(F.size("__left") - k, F.lit(0)))).withColumn("__right", F.slice("__right", F.lit(1), m))
    got = got.withColumn("p_from", F.col("__a") - F.size("__left")).withColumn("p_to", F.col("__b") + F.size("__right")).withColumn("p_tokens", F.concat("__left", "__mid", "__right"))
    return got.withColumn("passage", F.array_join("p_tokens", "")).select(*hits.columns, "p_from", "p_to", "p_tokens", "passage")


def expand_all(placed: DataFrame, expansion: Expansion, capacity: int, stride: int, stop_tokens: list[list[str]] | None = None, alone: bool = False) -> DataFrame:
    """mem_id, section_id, chunk_no, p_from, p_to of every chunk of placed texts, as expand() has them where no chunk is retired.

    No chunk is joined or grouped: a text finds the stops among its tokens and the few of its section beside
    them, and its chunks look those up. alone: as placed, each text is a memory of its own.
    """
    if stop_tokens is None:
        stop_tokens = stops_of(expansion)
    sizes = sorted({len(s) for s in stop_tokens})
    rows = placed.withColumn("__base", F.col("from_seq")).withColumn("__ctx", F.col("tokens"))
    if sizes and not alone:
        n, m = max(expansion.most, 1), capacity + expansion.most
        w = Window.partitionBy("mem_id", "section_id").orderBy("from_seq")
        rows = rows.where("n_tokens > 0").withColumn("__before", T.last_tokens(F.flatten(F.collect_list(T.last_tokens(F.col("tokens"), n)).over(w.rowsBetween(-n, -1))), n))
        rows = rows.withColumn("__after", F.flatten(F.collect_list(F.slice("tokens", 1, m)).over(w.rowsBetween(1, m))))
        rows = rows.withColumn("__base", F.col("from_seq") - F.size("__before")).withColumn("__ctx", F.concat("__before", "tokens", "__after"))

    def starts(size: int) -> Column:
        def at(t: Column, i: Column) -> Column:
            found = F.lit(False)
            for s in (s for s in stop_tokens if len(s) == size):
                same = t == s[0]
                for j in range(1, size):
                    same = same & (F.get("__ctx", i + j) == s[j])
                found = found | same
            return F.when(found, i)

        return F.filter(F.transform("__ctx", at), lambda i: i.isNotNull()).alias(f"s{size}")

    keys = ["mem_id", "section_id"]
    longs = ["from_seq", "to_seq", "section_from", "section_to", "__base"]
    rows = rows.select(*keys, *(F.col(c).cast("long").alias(c) for c in longs), *(starts(n) for n in sizes))
    least, most = expansion.least, expansion.most

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        f, to, lo, hi, base = (b.column(c).to_numpy(zero_copy_only=False) for c in longs)
        first = -((lo - f) // stride)
        n = np.maximum(-((lo - to) // stride) - first, 0)
        row = np.repeat(np.arange(len(n)), n)
        i = first[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        start = lo[row] + i * stride
        lo, hi, base = lo[row], hi[row], base[row]
        end = np.minimum(start + capacity, hi)
        left, right = np.maximum(start - least, lo), np.minimum(end + least, hi)
        p_from, p_to = np.maximum(start - most, lo), np.minimum(end + most, hi)
        at = lambda x: row * WIDE + (x - base)
        low, high = at(p_from), at(p_to)
        best_l, best_r = np.full(len(row), -1), np.full(len(row), np.iinfo(np.int64).max)
        for size in sizes:  # the latest or earliest start counts, then the longest or shortest stop
            col = b.column(f"s{size}")
            x = np.repeat(np.arange(len(n)), col.value_lengths().to_numpy(zero_copy_only=False)) * WIDE + col.flatten().to_numpy(zero_copy_only=False)
            x = np.concatenate([[-WIDE], x, [np.iinfo(np.int64).max - size]])
            last = x[np.searchsorted(x[:-1], at(left) - size, "right") - 1]
            ok = (last >= low) & (last >= best_l)
            best_l, p_from = np.where(ok, last, best_l), np.where(ok, last + size - row * WIDE + base, p_from)
            r = x[np.searchsorted(x, at(right), "left")]
            ok = (r + size <= high) & (r < best_r)
            best_r, p_to = np.where(ok, r, best_r), np.where(ok, r + size - row * WIDE + base, p_to)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(i), pa.array(p_from), pa.array(p_to)], [*keys, "chunk_no", "p_from", "p_to"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = np.cumsum(b.column("to_seq").to_numpy(zero_copy_only=False) - b.column("from_seq").to_numpy(zero_copy_only=False)) // (stride * BATCH)
            ends = [*(np.flatnonzero(np.diff(done)) + 1), len(done)]
            for x, y in zip([0, *ends], ends, strict=False):
                yield cut(b.slice(x, y - x))

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(scan, f"mem_id {kinds['mem_id']}, section_id {kinds['section_id']}, chunk_no long, p_from long, p_to long")


def overlaps(included: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether [a, b) has an end among included token places and at least a share `threshold` of its tokens."""
    end = F.array_contains(included, a) | F.array_contains(included, b - 1)
    share = F.size(F.array_intersect(included, F.sequence(a, b - 1))) / (b - a)
    return (b > a) & end & (share >= threshold)


def greedy(rows: DataFrame, threshold: float, most: int, group: str = "query_id", order: str = "ord", keep_overlaps: bool = False) -> DataFrame:
    """Rows (group, ord, p_from, p_to, ...) left by greedy removal, at most `most` a group.

    keep_overlaps keeps all rows until `most` of them do not overlap. A group is a search result, so its
    size is bounded by the search, and it is folded in one expression.
    """
    cols = [c for c in rows.columns if c not in (group,)]
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *cols))).alias("__r"))
    kind = dict(g.dtypes)["__r"]
    zero = F.struct(F.array().cast(kind).alias("out"), F.array().cast("array<bigint>").alias("inc"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        hit = overlaps(s["inc"], x["p_from"], x["p_to"], threshold)
        grown = F.when(x["p_to"] > x["p_from"], F.array_union(s["inc"], F.sequence(x["p_from"], x["p_to"] - 1))).otherwise(s["inc"])
        take = F.struct(F.array_append(s["out"], x).alias("out"), grown.alias("inc"), (s["n"] + F.when(hit, 0).otherwise(1)).alias("n"))
        skip = take if keep_overlaps else s
        return F.when(s["n"] >= most, s).when(hit, skip).otherwise(take)

    out = g.select(group, F.explode(F.aggregate("__r", zero, step)["out"]).alias("x"))
    return out.select(group, *(F.col(f"x.{c}").alias(c) for c in cols))
