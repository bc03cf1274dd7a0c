"""Near copies by chosen-path set similarity join.

A document is its set of distinct five-word shingles. Documents with equal sets form a class, and each
class goes on as one. A class has a sketch of ``SKETCH`` minwise values. In each of several trees it
walks a path: the path so far chooses one minwise function, and that function's minwise token of the
set is the next branch. A node of at most ``NODE`` classes is compared exhaustively by sketches; the
classes of larger ones go to the next depth. At the last depth a larger node is cut into parts that
share its pivots. Then in a large node all pairs of different components are compared by pairs of blocks,
unless so many classes are outside its largest component that further trees cost less: then its classes
walk as many trees as pairs at the threshold need at the next depth. At the last depth all such pairs
are compared. Classes whose sketches could reach the threshold are confirmed on their full sets, of which
only such classes' are shuffled, and only across components. Links leave a task as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from . import scratch
from .components import Forest, components, sorted_groups

SKETCH, NODE = 128, 256
DEPTHS = (3, 5, 8)
#: Share of the pairs at the threshold that may meet in no node, over all depths.
MISS = 0.001
PIVOTS = 8
#: Up to so many links are joined to components in one task, a few dozen MB there; more in rounds of all tasks.
LINKS = 200_000
NUM, DEN, SIZE = 85, 100, 5
_rng = np.random.default_rng(9)
_A = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The least 32-bit values of a non-empty set under SKETCH functions."""
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, ((s[i : i + 2048, None] * _A + _B) >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def _doc_sets(b: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for rows, data, off in bt.chunks(b.column(0), b.column(1)):
        for i, s in zip(rows, bt.shingle_sets(*bt.word_hashes(bt.LOWER[data], off), size), strict=True):
            yield int(i), s


def paths(sk: np.ndarray, tree: int, depths: tuple[int, ...]) -> list[np.ndarray]:
    """Path keys of sketches at each depth of a tree."""
    path = np.full(len(sk), bt.mix(np.array([tree + 1], np.uint64))[0])
    out, rows = [], np.arange(len(sk))
    for d in range(1, depths[-1] + 1):
        which = (path % np.uint64(SKETCH)).astype(np.int64)
        path = bt.mix(path * bt._MUL + (which.astype(np.uint64) << np.uint64(32)) + sk[rows, which])
        if d in depths:
            out.append(path.view(np.int64))
    return out


def tree_counts(similarity: float) -> list[int]:
    """Trees at each depth, so that pairs of that similarity miss each other at any depth in MISS of cases at most.

    All trees read one sketch, so the chance is the mean over how many of its values a pair shares.
    """
    shared = np.arange(SKETCH + 1)
    p = np.array([comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k) for k in shared.tolist()])
    out = []
    for d in DEPTHS:
        t = 1
        while p @ (1 - (shared / SKETCH) ** d) ** t > MISS / len(DEPTHS) and t < 10_000:
            t += 1
        out.append(t)
    return out


def _sketches(b: pa.RecordBatch, col: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(col).to_pylist()), np.uint32).reshape(b.num_rows, SKETCH)


def _pairs_in_runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys of a sorted array, a bounded number at a time."""
    edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    size = np.diff(np.append(edge, len(key)))
    for m in np.unique(size[size > 1]):
        i, j = np.triu_indices(m, 1)
        heads = edge[size == m]
        step = max(1, 200_000 // len(i))
        for k in range(0, len(heads), step):
            h = heads[k : k + step, None]
            yield (h + i).ravel(), (h + j).ravel()


def _mixed(member: DataFrame) -> DataFrame:
    """The rows of member(node, rep, comp) in nodes of several components, with the node's largest one as home and how many rows it and the others have."""
    sizes = member.groupBy("node", "comp").agg(F.count("rep").alias("c"))
    sizes = sizes.groupBy("node").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top")).where("all > top.c")
    return member.join(sizes.select("node", F.col("top.comp").alias("home"), F.col("top.c").alias("at_home"), (F.col("all") - F.col("top.c")).alias("outside")), "node")


def _across(member: DataFrame) -> DataFrame:
    """(key, rep, comp) that bring together all pairs of different comp of each node of member(node, rep, comp)."""
    return _blocks(_mixed(member))


def _blocks(mixed: DataFrame) -> DataFrame:
    """(key, rep, comp) that bring together all pairs of different comp of each node of _mixed().

    The members outside a node's largest component meet all blocks, those of the largest only the others' blocks.
    """
    half = NODE // 2
    at_home = F.col("comp") == F.col("home")
    rows = mixed.select("node", "rep", "comp", "home", F.ceil(F.col("outside") / half).cast("long").alias("others"), F.ceil(F.col("at_home") / half).cast("long").alias("homes"))
    block = F.when(at_home, F.col("others") + F.pmod(F.xxhash64("rep", "node"), F.col("homes"))).otherwise(F.pmod(F.xxhash64("rep", "node"), F.col("others")))
    meets = F.sequence(F.lit(0).cast("long"), F.when(at_home, F.col("others")).otherwise(F.col("others") + F.col("homes")) - 1)
    rows = rows.select("node", "rep", "comp", block.alias("block"), F.explode(meets).alias("other"))
    return rows.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "rep", "comp")


def _links(sets: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of non-empty sets of different comp, as pairs of comp."""
    out: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    start = np.append(0, np.cumsum(size))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(ids.max() + 1, np.int64)
    root = comp.copy()
    for i in range(1, len(sets)):
        fits = den * np.minimum(size[:i], size[i]) >= num * np.maximum(size[:i], size[i])
        own = ids[start[i] : start[i + 1]]
        marked[own] = 1
        # One earlier set first: in a family it links and leaves no others to count.
        for most in (1, i):
            at = np.flatnonzero(fits & (root[:i] != root[i]))[:most]
            if not len(at):
                break
            if most == 1:
                both = marked[ids[start[at[0]] : start[at[0] + 1]]].sum(keepdims=True)
            else:
                both = np.add.reduceat(marked[ids[: start[i]]], start[:i])[at]
            for j in at[den * both >= num * (size[at] + size[i] - both)].tolist():
                if root[j] != root[i]:
                    out.append((int(comp[i]), int(comp[j])))
                    root[root == root[j]] = root[i]
        marked[own] = 0
    return out


def near_groups(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs.

    Documents are linked when den * |intersection| >= num * |union| of their shingle sets. A text of
    fewer than `size` words is one shingle; a null text or one without words has none and links with
    nothing. Every link returned is exact; of the links at the threshold the trees find all but about
    one in a thousand at any depth, of closer ones more. A row with a null id is its own group. Rows that repeat an
    id share its group. Other columns are left out. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            ids = b.column(0).to_pylist()
            out = []
            for i, s in _doc_sets(b, size):
                hi, lo = (int(bt.mix(np.array([np.bitwise_xor.reduce(bt.mix(s + c))], np.uint64))[0]) if len(s) else 0 for c in (bt._C1, bt._C2))
                out.append((ids[i], len(s), hi.to_bytes(8, "big") + lo.to_bytes(8, "big") if len(s) else None, sketch(s).tobytes() if len(s) else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "n", "set_key", "sketch"])

    described = scratch.save(docs.mapInArrow(describe, "doc_id long, n long, set_key binary, sketch binary"), "sketches")
    # Equal keys have equal sketches, so any row's sketch stands for the class.
    classes = scratch.save(described.where("set_key is not null and doc_id is not null").groupBy("set_key", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")

    counts = tree_counts(num / den)

    def walk(active: DataFrame, depth: int, trees: int) -> DataFrame:
        """(node, rep, comp) of each tree of active(rep, comp, sketch)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bt.small(batches):
                for i in range(0, b.num_rows, 4096):
                    part = b.slice(i, 4096)
                    sk = _sketches(part)
                    for t in range(trees):
                        yield pa.RecordBatch.from_arrays([pa.array(paths(sk, t, (depth,))[0]), part.column("rep"), part.column("comp")], ["node", "rep", "comp"])

        return active.select("rep", "comp", "sketch").mapInArrow(run, "node long, rep long, comp long")

    def going_on(large: DataFrame) -> DataFrame:
        """The classes of the rows of large(rep, comp), with their sketches."""
        return scratch.save(classes.select("rep", "sketch").join(large.select("rep", "comp").distinct(), "rep"), "large-nodes")

    def united(leaves: list[DataFrame]) -> DataFrame:
        leaf = leaves[0]
        for x in leaves[1:]:
            leaf = leaf.unionByName(x)
        return leaf

    def descend() -> tuple[DataFrame, DataFrame]:
        """(key, rep, comp) of classes to compare, each its own component, and the rows of the large nodes of the first depth."""
        active, leaves, first = classes.withColumn("comp", F.col("rep")), [], None
        for d in DEPTHS[:-1]:
            cur = walk(active, d, counts[0])
            n = cur.groupBy("node").agg(F.count("rep").alias("members")).where("members > 1")
            cur = scratch.save(cur.join(n, "node"), "paths")
            leaves.append(cur.where(f"members <= {NODE}").select(F.col("node").alias("key"), "rep", "comp"))
            large = cur.where(f"members > {NODE}").drop("members")
            first = large if first is None else first
            active = going_on(large)
            if active.isEmpty():
                return united(leaves), first
        cur = walk(active, DEPTHS[-1], counts[0])
        pivots = F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(p))) for p in range(PIVOTS)))
        n = cur.groupBy("node").agg(F.count("rep").alias("members"), pivots.alias("pivots")).where("members > 1")
        n = n.select("node", "pivots", F.ceil(F.col("members") / (NODE - PIVOTS)).cast("long").alias("parts"))
        own = F.array(F.pmod(F.xxhash64("rep", "node"), F.col("parts")))
        part = F.when(F.array_contains("pivots", F.col("rep")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own)
        rows = cur.join(n, "node").select("node", "rep", "comp", F.explode(part).alias("part"))
        return united([*leaves, rows.select(F.xxhash64("node", "part").alias("key"), "rep", "comp")]), first

    def rest(first: DataFrame, comp: DataFrame) -> DataFrame:
        """(key, rep, comp) of the pairs of different comp that descend() left in large nodes.

        A large node is compared at once if each class so meets no more others than in full small nodes of
        all further trees. Both classes of a pair in another one go on, so a pair is lost only if at some
        depth no tree brings it together.
        """
        cur, leaves = first.select("node", "rep").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), []
        for i, d in enumerate(DEPTHS):
            if i:
                cur = walk(active, d, counts[i])
            cur = scratch.save(_mixed(cur), "mixed-nodes")
            small, few = F.col("at_home") + F.col("outside") <= NODE, F.col("outside") * counts[i] <= NODE * sum(counts[i + 1 :])
            leaves.append(cur.where(small).select(F.col("node").alias("key"), "rep", "comp"))
            leaves.append(_blocks(cur.where(~small if d == DEPTHS[-1] else ~small & few)))
            if d < DEPTHS[-1]:
                active = going_on(cur.where(~small & ~few))
                if active.isEmpty():
                    break
        return united(leaves)

    least = num / den - 4 * (num / den * (1 - num / den) / SKETCH) ** 0.5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches):
            key, rep, n, comp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "n", "comp"))
            sk = _sketches(b)
            forest = Forest()
            for i, j in _pairs_in_runs(key):
                ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (comp[i] != comp[j])
                i, j = i[ok], j[ok]
                for k in range(0, len(i), 20_000):
                    x, y = i[k : k + 20_000], j[k : k + 20_000]
                    hit = (sk[x] == sk[y]).mean(1) >= least
                    for u, v in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                        forest.join(u, v)
            found: dict[int, list[int]] = {}
            for u in forest.parent:
                found.setdefault(forest.find(u), []).append((int(rep[u]), int(comp[u])))
            groups = [[{"rep": r, "comp": c} for r, c in sorted(set(x))] for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.list_(pa.struct([("rep", pa.int64()), ("comp", pa.int64())])))], ["members"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            ids, comps, keys = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, s in _doc_sets(b, size):
                m = len(keys[i]) if len(s) else 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[i][:m], pa.int64()), pa.array([ids[i]] * m, pa.int64()), pa.array([comps[i]] * m, pa.int64()), pa.array([s.tobytes()] * m, pa.binary())], ["key", "rep", "comp", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches):
            key, rep, comp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "comp"))
            sets = b.column("shingles")
            out: list[tuple[int, int]] = []
            edge = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                rows = np.lexsort((rep[a:z], comp[a:z])) + a
                out += _links([np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in rows], comp[rows], num, den)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    n_parts = scratch.parts(docs.sparkSession, 0)

    def linked(leaf: DataFrame) -> DataFrame:
        """Links (u, v) of components, between classes of different comp that share a key of leaf(key, rep, comp)."""
        leaf = leaf.join(classes.select("rep", "n", "sketch"), "rep").select("key", "rep", "n", "comp", "sketch").repartition(n_parts, "key").sortWithinPartitions("key")
        groups = leaf.mapInArrow(compare, "members array<struct<rep: long, comp: long>>").groupBy(F.xxhash64("members").alias("key"), "members").agg(F.lit(1)).select("key", F.inline("members"))
        asked = scratch.save(groups.groupBy(F.col("rep").alias("doc_id"), "comp").agg(F.collect_set("key").alias("keys")), "candidates")  # a few keys for each tree at most
        sets = docs.join(asked, "doc_id").select("doc_id", "text", "comp", "keys").mapInArrow(to_sets, "key long, rep long, comp long, shingles binary")
        return sets.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(confirm, "u long, v long")

    # The first depth's trees link the large families; what large nodes then hold of several components is compared after that.
    leaf, first = descend()
    comp = components(linked(leaf), at_once=LINKS)
    if not first.isEmpty():
        more = scratch.save(linked(rest(first, comp.select(F.col("id").alias("rep"), F.col("component_id").alias("comp")))), "more-links")
        if not more.isEmpty():
            comp = components(comp.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(more), at_once=LINKS)
    of_class = classes.select("set_key", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
