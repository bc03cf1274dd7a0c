"""Connected components of a link table by alternating stars, all distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


class Forest:
    """Union-find over arbitrary ids; each root is the smallest id of its tree."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while (up := p.get(x, x)) != root:
            p[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a partition as stars around each tree's smallest id; flushed before it grows large."""

    def flush(f: Forest) -> pa.RecordBatch:
        rows = [(x, r) for x in f.parent if (r := f.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["u", "v"])

    f = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f.join(x, y)
        if len(f.parent) > 500_000:
            yield flush(f)
            f = Forest()
    yield flush(f)


def components(links: DataFrame, a: str = "u", b: str = "v", at_once: int = 0) -> DataFrame:
    """(id, component_id) of every id in links; component_id is the smallest id that links reach.

    Rows with a null end are no links. Repeated links and links of an id with itself change nothing.
    An id without links is not returned. Each round writes its links, so lineage stays short. Where at
    most at_once links, or 250,000, are left once each task has joined its own, one task joins them all.
    """
    stars = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(local_forest, "u long, v long")
    cur, mark = scratch.save(stars, "links"), None
    if at_once and (cur.count() <= min(at_once, 250_000)):  # so few that local_forest flushes nothing before the end
        one = scratch.save(cur.coalesce(1).mapInArrow(local_forest, "u long, v long"), "small")
        scratch.drop(cur)
        return _with_roots(one)
    while True:
        both = cur.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(cur.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = scratch.save(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = scratch.save(small.distinct(), "small")
        now = tuple(new.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(large)
        scratch.drop(cur)
        cur = new
        if now == mark:
            break
        mark = now
    return _with_roots(cur)


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.RecordBatch]:
    """Batches cut so that no run of equal keys is split; the input is sorted by key within the partition."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], "left"))
        if held and held[-1].column(key)[0].as_py() == k[0] and last == 0:
            held.append(b)
            continue
        if last or held:
            out = [*held, b.slice(0, last)] if last else held
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
