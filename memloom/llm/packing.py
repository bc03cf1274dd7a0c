"""Packing along a space-filling curve.

Each text becomes ids and a hashed bag-of-ids vector, projected to three dimensions and turned into a
Hilbert key. Texts are sorted by that key in ranges, so neighbours on the curve share sequences, and
laid end to end; a text is cut where a sequence of ``size`` ids is full. Only the last sequence can
have padding. Ids are written once, as 16-bit values, and shuffled once, to their range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from . import scratch

HASHED, DIMS, BITS = 256, 3, 10
#: Ranges at most; the driver holds a bound and a sum of each. Larger ranges are sorted with spill and read as streams.
MOST_RANGES = 1 << 16
_axes = np.random.default_rng(10).standard_normal((HASHED, DIMS))
_loaded: dict[str, object] = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(path: str):
    """Ids of the tokenizers file at `path`, by a faster encoder built from the same vocabulary and merges."""
    if path not in _loaded:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _loaded[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of non-negative integers below 2**bits (Skilling's transform)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of id sequences: hashed counts, unit length, three projections, a logistic squash to 10 bits."""
    v = np.zeros((len(ids), HASHED))
    for r, a in zip(v, ids, strict=True):
        r += np.bincount((a.astype(np.int64) * 40503 >> 4) % HASHED, minlength=HASHED)
    v /= np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None]
    y = 1 / (1 + np.exp(-2 * (v @ _axes)))
    return hilbert(np.minimum((y * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of the texts of docs in sequences of `size` ids.

    Columns as in PIECES. A null text is empty and has its end id alone. Repeated rows are packed each;
    rows with equal keys follow in order of a hash of the id, then of the id. Other columns of docs are
    left out. An empty table gives an empty result. The order of equal rows changes no result.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in bt.small(batches):
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [np.append(enc.encode_to_numpy(t or "", allowed_special="all"), end_id).astype(np.uint16) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(ids), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "curve", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, curve long, n long, ids binary")
    rows = rows.withColumn("place", F.shiftleft("curve", 32).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)))).drop("curve")
    rows = scratch.save(rows, "pack-ids")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], PIECES)
    n_ranges = min(scratch.parts(spark, 2 * total, 8 << 20), MOST_RANGES)
    bounds = np.unique(rows.approxQuantile("place", [i / n_ranges for i in range(1, n_ranges)], 0.25 / n_ranges)).astype(np.int64) if n_ranges > 1 else np.zeros(0, np.int64)

    def to_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            yield b.append_column("part", pa.array(np.searchsorted(bounds, b.column("place").to_numpy(zero_copy_only=False), "right"), pa.int64()))

    cells = rows.select("place", "n").mapInArrow(to_range, "place long, n long, part long").groupBy("part").agg(F.sum("n").alias("n"))
    sums = {r.part: r.n for r in cells.collect()}  # at most MOST_RANGES rows
    base, at = {}, 0
    for k in sorted(sums):
        base[k], at = at, at + sums[k]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in bt.small(batches):
            out: list[tuple] = []
            for d, ids, part in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "part")), strict=True):
                if part != now:
                    now, at = part, base[part]
                a, s = np.frombuffer(ids, np.uint16).astype("<u4"), 0
                while s < len(a):
                    k = min(len(a) - s, size - at % size)
                    out.append((d, s, k, zlib.crc32(a[s : s + k].tobytes()), len(a), at // size, at % size))
                    s, at = s + k, at + k
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = rows.mapInArrow(to_range, "doc_id long, n long, ids binary, place long, part long").drop("n")
    placed = placed.repartition(n_ranges, "part").sortWithinPartitions("part", "place", "doc_id")
    return placed.mapInArrow(cut, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
