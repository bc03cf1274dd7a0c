"""Near copies of vectors by dual traversal of cover trees.

Vectors of one label are compared by cosine; on the unit sphere a cosine of at least c is a distance of
at most sqrt(2 - 2c). Equal vectors form a class that goes on as one. A label's classes are cut into
blocks: by the nearest of some of its own vectors, the tree's upper level, within those by rings of the
distance to it, and by a hash where a block would still be too large. Blocks too far apart by their
covering radii or rings are never paired.

A pair of blocks meets in one task. There each block becomes a cover tree: nested levels of centres with
halving radii. Both trees are walked together; a pair of nodes is dropped when its centres are further
apart than the distance and both covering radii, linked whole when it must lie within the distance, and
opened otherwise. What is left is compared exactly. Links leave the task as counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .components import Forest, components

COSINE, BLOCK, PIVOTS = 0.98, 1024, 4096
#: Nodes of so few rows are not split.
LEAF = 8
RADII = tuple(2.0 / 2**i for i in range(1, 6))
SLACK = 1e-6


class CoverTree:
    """Levels of centres (numbers of rows of x), the rows below each, and exact covering radii."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        dots = x @ x.T  # a block's own, so of bounded size
        self.nodes: list[list[np.ndarray]] = [[np.arange(n)]]  # rows below each node, its centre first
        self.children: list[list[list[int]]] = []
        for r in RADII:
            level, links = [], []
            for rows in self.nodes[-1]:
                own = []
                if len(rows) <= LEAF:
                    own.append(len(level))
                    level.append(rows)
                    links.append(own)
                    continue
                near, left = dots[np.ix_(rows, rows)] >= 1 - r * r / 2, np.ones(len(rows), bool)
                for c in range(len(rows)):
                    if left[c]:
                        mine = near[c] & left
                        mine[c] = False
                        left &= ~mine
                        left[c] = False
                        own.append(len(level))
                        level.append(np.append(rows[c], rows[mine]))
                links.append(own)
            self.nodes.append(level)
            self.children.append(links)
            if all(len(rows) <= LEAF for rows in level):
                break
        self.centre = [np.array([rows[0] for rows in level]) for level in self.nodes]
        self.radius = [np.array([np.sqrt(max(0.0, 2 - 2 * float(dots[rows[0], rows].min()))) for rows in level]) for level in self.nodes]


def dual_links(a: CoverTree, b: CoverTree, cosine: float, same: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs of row sets that all link, and pairs of rows (as two arrays) that link; for a tree with itself each unordered pair once, besides whole nodes."""
    far = np.sqrt(2 - 2 * cosine)
    whole, single = [], []
    depth = min(len(a.nodes), len(b.nodes))

    def near(level: int, p: np.ndarray, q: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of nodes p and q of a level that may hold links, and their centres' distance."""
        d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centre[level][p]] @ b.x[b.centre[level][q]].T)))
        ok = d <= far + a.radius[level][p][:, None] + b.radius[level][q] + SLACK
        r, c = np.nonzero(ok & (p[:, None] <= q) if once else ok)
        return p[r], q[c], d[r, c]

    i, j, d = near(0, np.zeros(1, np.int64), np.zeros(1, np.int64), False)
    for level in range(depth):
        ra, rb = a.radius[level][i], b.radius[level][j]
        sizes = np.array([len(x) for x in a.nodes[level]])[i] * np.array([len(x) for x in b.nodes[level]])[j]
        inside = (d + ra + rb <= far - SLACK) & (sizes > 1)
        whole += [(a.nodes[level][p], b.nodes[level][q]) for p, q in zip(i[inside].tolist(), j[inside].tolist(), strict=True)]
        i, j, sizes = i[~inside], j[~inside], sizes[~inside]
        leaf = (sizes <= 4096) | (level == depth - 1)
        small = leaf & (sizes <= 1)
        p, q = a.centre[level][i[small]], b.centre[level][j[small]]
        if len(p):
            hit = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine
            single.append((p[hit], q[hit]))
        for u, v in zip(i[leaf & ~small].tolist(), j[leaf & ~small].tolist(), strict=True):
            rows, cols = a.nodes[level][u], b.nodes[level][v]
            x, y = np.nonzero(a.x[rows] @ b.x[cols].T >= cosine)
            single.append((rows[x], cols[y]))
        i, j = i[~leaf], j[~leaf]
        if not len(i):
            break
        opened = []
        for u, v in zip(i.tolist(), j.tolist(), strict=True):
            opened.append(near(level + 1, np.array(a.children[level][u]), np.array(b.children[level][v]), same and u == v))
        i, j, d = (np.concatenate(z) for z in zip(*opened, strict=True))
    return whole, single


def block_links(x: np.ndarray, nx: np.ndarray, y: np.ndarray | None, ny: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Linked vectors of each row of x and of y (weights nx, ny), and links that span their groups (rows of y count on from x's). y None: x with itself."""
    a = CoverTree(x)
    same = y is None
    b = a if same else CoverTree(y)
    whole, single = dual_links(a, b, cosine, same)
    cx, cy = np.zeros(len(x), np.int64), np.zeros(0 if same else len(y), np.int64)
    shift = 0 if same else len(x)
    out, forest = [], Forest()
    for p, q in whole:
        if same and p is q:
            cx[p] += nx[p].sum() - nx[p]
        elif same:
            cx[p] += nx[q].sum()
            cx[q] += nx[p].sum()
        else:
            cx[p] += ny[q].sum()
            cy[q] += nx[p].sum()
        for u, v in [*((int(p[0]), int(v) + shift) for v in q), *((int(q[0]) + shift, int(u)) for u in p)]:
            if forest.join(u, v):
                out.append((u, v))
    if single:
        p, q = (np.concatenate(z) for z in zip(*single, strict=True))
        if same:  # within a node both orders were made
            key = np.unique(np.minimum(p, q) * len(x) + np.maximum(p, q))
            p, q = key // len(x), key % len(x)
            p, q = p[p != q], q[p != q]
            np.add.at(cx, p, nx[q])
            np.add.at(cx, q, nx[p])
        else:
            np.add.at(cx, p, ny[q])
            np.add.at(cy, q, nx[p])
        # Each row's first link, then what still joins two groups.
        root = np.arange(len(x) + len(cy))
        v = q + shift
        while len(p):
            low = np.minimum(root[p], root[v])
            new = root.copy()
            np.minimum.at(new, root[p], low)
            np.minimum.at(new, root[v], low)
            while (new != new[new]).any():
                new = new[new]
            root = new[root]
            live = root[p] != root[v]
            p, v = p[live], v[live]
        for u in np.flatnonzero(root != np.arange(len(root))).tolist():
            if forest.join(u, int(root[u])):
                out.append((u, int(root[u])))
    return cx, cy, out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id, kept for each row of vectors.

    Only rows with equal labels and equally long vectors are compared. A row with a null id or label, or
    a vector that is null, empty, zero or has null or non-finite components, links with nothing. Rows
    that repeat an id and vector link with each other. An id names one vector; where it names several,
    they share their counts. Other columns are left out. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(2).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                with np.errstate(over="ignore", invalid="ignore"):
                    big = float(np.abs(x).max()) if len(x) else 0.0
                    size = float(np.sqrt(np.dot(x / big, x / big))) * big if big and np.isfinite(big) else 0.0
                out.append((x / big / (size / big)).tobytes() if size and np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "unit"])

    rows = scratch.save(rows.mapInArrow(unit, "id long, label string, unit binary"), "units")
    good = rows.where("id is not null and label is not null and unit is not null")
    classes = scratch.save(good.groupBy("label", "unit").agg(F.min("id").alias("rep"), F.count("id").alias("n")), "vector-classes")

    # Upper level: a label with more than a block of classes gets one centre for each block, as far as PIVOTS reach.
    sizes = classes.groupBy("label").agg(F.count("rep").alias("m")).where(F.col("m") > block)
    chance = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(block)) == 0
    top = classes.join(sizes, "label").where(chance).orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).select("label", "unit").collect()
    centres: dict[tuple[str, int], np.ndarray] = {}
    for r in top:
        k = (r["label"], len(r["unit"]))
        centres.setdefault(k, []).append(np.frombuffer(r["unit"], np.float64))  # type: ignore[union-attr, arg-type]
    centres = {k: np.array(v) for k, v in centres.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, dists = [], []
            for label, u in zip(b.column("label").to_pylist(), b.column("unit").to_pylist(), strict=True):
                c = centres.get((label, len(u)))
                if c is None:
                    cells.append(-1)
                    dists.append(2.0)
                else:
                    s = c @ np.frombuffer(u, np.float64)
                    cells.append(int(s.argmax()))
                    dists.append(float(np.sqrt(max(0.0, 2 - 2 * s.max()))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32()), pa.array(dists, pa.float64())], [*b.schema.names, "cell", "dist"])

    routed = scratch.save(classes.mapInArrow(route, classes.schema.simpleString()[7:-1].replace(":", " ") + ", cell int, dist double"), "routed")
    far = float(np.sqrt(2 - 2 * cosine))
    # Rings only in cells of several blocks; smaller ones would only make more pairs.
    most = 2 * block
    wide = routed.groupBy("label", F.length("unit").alias("dim"), "cell").agg(F.count("rep").alias("m")).where(F.col("m") > 2 * most).select("label", "dim", "cell", F.lit(True).alias("wide"))
    routed = routed.withColumn("dim", F.length("unit")).join(wide, ["label", "dim", "cell"], "left")
    routed = routed.withColumn("ring", F.when(F.col("wide"), F.floor(F.col("dist") / F.lit(max(far, 0.05))).cast("int")).otherwise(0)).drop("wide")
    cells = routed.groupBy("label", "dim", "cell", "ring").agg(F.count("rep").alias("m"), F.max("dist").alias("radius"), F.min("dist").alias("inner"))
    cells = cells.withColumn("subs", F.ceil(F.col("m") / F.lit(most)).cast("int"))
    members = routed.join(cells.select("label", "dim", "cell", "ring", "subs"), ["label", "dim", "cell", "ring"])
    members = members.withColumn("block", F.xxhash64("label", "dim", "cell", "ring", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("subs")))).select("block", "rep", "n", "unit")
    blocks = cells.select("label", "dim", "cell", "ring", "radius", "inner", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    blocks = scratch.save(blocks.withColumn("block", F.xxhash64("label", "dim", "cell", "ring", F.col("sub").cast("long"))), "blocks")

    def pairs_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for label, dim, ca, ra, ia, cb, rb, ib in zip(*(b.column(c).to_pylist() for c in ("label", "dim", "cell", "radius", "inner", "cell2", "radius2", "inner2")), strict=True):
                c = centres.get((label, dim))
                d = 0.0 if c is None or ca == cb else np.sqrt(max(0.0, 2 - 2 * float(c[ca] @ c[cb])))
                # All of one block lie between inner and radius from its centre.
                keep.append(d <= ra + rb + far + SLACK and ia <= d + rb + far + SLACK and ib <= d + ra + far + SLACK)
            yield b.select(["block", "block2"]).filter(pa.array(keep, pa.bool_()))

    # A label may hold most blocks: its left side is dealt over salts, its right side goes to each.
    salts = 16
    left = blocks.withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    right = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("inner").alias("inner2"), F.col("block").alias("block2"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = left.join(right, ["label", "dim", "salt"]).where("block <= block2").mapInArrow(pairs_apart, "block long, block2 long")
    pairs = pairs.withColumn("pair", F.xxhash64("block", "block2"))
    sides = pairs.select("pair", "block", F.lit(0).alias("side")).unionByName(pairs.where("block <> block2").select("pair", F.col("block2").alias("block"), F.lit(1).alias("side")))

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        side, rep, n = (t.column(c).to_numpy() for c in ("side", "rep", "n"))
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(b):
            cx, cy, links = block_links(x[a], n[a], x[b], n[b], cosine)
            count, ids = np.concatenate([cx, cy]), np.concatenate([rep[a], rep[b]])
        else:
            count, _, links = block_links(x[a], n[a], None, None, cosine)
            ids = rep[a]
        u = np.array([p for p, _ in links], np.int64)
        v = np.array([q for _, q in links], np.int64)
        some = np.flatnonzero(count)
        return pa.table({"u": pa.array(np.concatenate([ids[some], ids[u]]), pa.int64()), "v": pa.array([None] * len(some) + ids[v].tolist(), pa.int64()), "links": pa.array(np.concatenate([count[some], np.zeros(len(u), np.int64)]), pa.int64())})

    met = scratch.save(sides.join(members, "block").select("pair", "side", "rep", "n", "unit").groupBy("pair").applyInArrow(meet, "u long, v long, links long"), "met")
    counts = met.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(met.where("v is not null")).withColumnRenamed("id", "rep")
    of_class = classes.join(counts, "rep", "left").join(comp, "rep", "left").select("label", "unit", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.withColumn("label", F.when(F.col("id").isNotNull(), F.col("label"))).join(of_class, ["label", "unit"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
