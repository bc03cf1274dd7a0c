"""Vector store: upsert, delete, exact nearest neighbours, hashed embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384


def upsert(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """store without the keys of new, and new."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


class _Best:
    """The k nearest ids that some rows of queries have met so far."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.q32, self.k, self.far = q, q.astype(np.float32), k, np.full(len(q), np.inf)
        self.square = (q * q).sum(1)
        self.r, self.ids, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def see(self, ids: np.ndarray, v: np.ndarray, v32: np.ndarray | None, square: np.ndarray, first: np.ndarray) -> None:
        """Rows in order of id; first has the first row of each. v32, if given, is v in single precision: it rules rows out, what is left is measured in double."""
        if v32 is None:
            near = self.square[:, None] + square - 2 * self.q @ v.T
            near[np.isnan(near)] = np.inf  # no number is near nothing
            slack = 1e-8
        else:
            near = self.q32 @ v32.T
            near *= -2
            near += square.astype(np.float32)
            near += self.square.astype(np.float32)[:, None]
            # More than a product of singles can be off.
            slack = 1e-8 + 2.4e-7 * (v.shape[1] + 8) * float(self.square.max(initial=0) + square.max(initial=0))
        far = self.far
        new = np.isinf(far)
        if new.any() and len(first) >= self.k:
            some = near[new] if len(first) == len(ids) else np.minimum.reduceat(near[new], first, axis=1)
            far = far.copy()
            far[new] = np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + slack
        r, t = np.nonzero(near <= (far + slack).astype(near.dtype)[:, None])
        if not len(r):
            return
        d = np.concatenate([((self.q[r[i : i + 65_536]] - v[t[i : i + 65_536]].astype(np.float64)) ** 2).sum(1) for i in range(0, len(r), 65_536)])
        ok = np.isfinite(d)
        r, own, d = (np.concatenate(x) for x in ((self.r, r[ok]), (self.ids, ids[t[ok]]), (self.d, d[ok])))
        order = np.lexsort((d, own, r))
        r, own, d = r[order], own[order], d[order]
        once = np.ones(len(r), bool)
        once[1:] = (r[1:] != r[:-1]) | (own[1:] != own[:-1])
        r, own, d = r[once], own[once], d[once]
        order = np.lexsort((own, np.round(d, 9), r))
        r, own, d = r[order], own[order], d[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < self.k
        self.r, self.ids, self.d = r[keep], own[keep], d[keep]
        n = np.bincount(self.r, minlength=len(self.q))
        full = n >= self.k
        self.far[full] = self.d[np.cumsum(n)[full] - 1]


def nearest(store: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", decode: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """query_id, id, distance (squared), rank of the k nearest ids of each query; ties go to the smaller id.

    Several vectors of an id count by their nearest. Rows with a null id or vector are not found. Queries
    are held by the tasks in blocks of QUERY_BLOCK; each task keeps its k best a query over all its Arrow
    batches and looks closer only at rows that may be nearer, so only the best of a task are shuffled. decode makes
    the vectors of a batch from what the store's column holds instead, where that is much smaller.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i)
        rows = part.where(f"{query_id} is not null and {vector_col} is not null").select(query_id, vector_col).collect()  # a block of bounded size
        q_ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)

        def scan(batches: Iterator[pa.RecordBatch], q_ids: np.ndarray = q_ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            if not len(q_ids):
                return
            best = [_Best(q[j : j + 256], k) for j in range(0, len(q), 256)]
            big = np.abs(q).max(initial=0) > 1e15
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                v = decode(b.column(1)) if decode else b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if (np.diff(ids) < 0).any():
                    order = np.argsort(ids, kind="stable")
                    ids, v = ids[order], v[order]
                first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
                single = None if big or not max(v.max(initial=0), -v.min(initial=0)) < 1e15 else v.astype(np.float32, copy=False)
                v = v if v.dtype.kind == "f" and single is not None else v.astype(np.float64)
                square = np.einsum("ij,ij->i", v, v)
                for x in best:
                    x.see(ids, v, single, square, first)
            for j, x in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[256 * j + x.r]), pa.array(x.ids), pa.array(x.d)], ["q", "id", "d"])

        got = store.where(f"{id_col} is not null and {vector_col} is not null").select(F.col(id_col).cast("long"), vector_col).mapInArrow(scan, "q long, id long, d double")
        found = got if found is None else found.unionByName(got)
    best = found.groupBy("q", "id").agg(F.min("d").alias("distance"))
    w = Window.partitionBy("q").orderBy(F.round("distance", 9), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "distance", F.col("rank").cast("long").alias("rank"))


def places(tokens_col: str = "tokens", dim: int = 256) -> Column:
    """Where each token that is no space counts in its text's vector."""
    words = F.filter(F.col(tokens_col), lambda t: F.length(F.trim(t)) > 0)
    return F.coalesce(F.transform(words, lambda t: F.pmod(F.xxhash64(F.lower(t)), F.lit(dim)).cast("int")), F.array().cast("array<int>"))


def counted(at: pa.Array, dim: int = 256) -> np.ndarray:
    """The vectors of a batch of places."""
    n = len(at)
    row = np.repeat(np.arange(n), at.value_lengths().to_numpy(zero_copy_only=False))
    x = np.bincount(row * dim + at.flatten().to_numpy(zero_copy_only=False), minlength=n * dim).astype(np.float32).reshape(n, dim)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    return x


def embed(texts: DataFrame, tokens_col: str = "tokens", dim: int = 256, out: str = "embedding") -> DataFrame:
    """Hashed bag of lower-case tokens, of unit length; an empty text is zero. The default embedder: hashed in the JVM, counted in Arrow batches."""

    def count(at: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(counted(at, dim).ravel()))

    return texts.withColumn(out, F.arrow_udf(count, "array<float>")(places(tokens_col, dim)))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two stores hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
