"""Removal of repeated passages with a distributed difference-cover suffix array.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier. One global suffix array
would sort every suffix of the corpus several times; its order is therefore split by content. Each
string of LENGTH bytes has an anchor, the leftmost of its ``GRAM``-byte grams with the least hash, and
equal strings have equal anchors at equal places. So:

1. Every run of string starts that share an anchor is one record (anchor hash, document, run). Records
   go to the hash's partition; hashes seen once cannot belong to a repeated string.
2. For the others, the run's bytes go to the hash's partition. Equal runs are one there, and only the
   earliest goes on. Where an anchor has different runs, a suffix array of their bytes is built by the
   difference cover modulo 3 (sort the sampled triples, name them, recurse on the names, sort and merge
   the rest); adjacent suffixes with LENGTH equal bytes form a class, and all but its earliest string
   are repeats.
3. The covered spans go back to their documents.

Hashes only choose places and partitions; every repeat is confirmed on its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import bytetext as bt
from . import scratch
from .components import sorted_groups

LENGTH, GRAM = 100, 32
STARTS = LENGTH - GRAM + 1
SEGMENT = 1 << 19
#: An anchor's runs of more bytes are split by further keys, so often at most.
SPLIT, LEVELS = 1 << 20, 12
_POS = np.uint64(20)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    t = np.concatenate([s, np.zeros(3, np.int64)])
    # Sampled suffixes, with one past the end where that closes the run of those at 1 modulo 3.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    pair = np.unique(t[sample] * (s.max() + 1) + t[sample + 1], return_inverse=True)[1].astype(np.int64)
    name = np.unique(pair * (s.max() + 1) + t[sample + 2], return_inverse=True)[1].astype(np.int64) + 1
    if name.max() < len(sample):
        order = suffix_array(name)
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    big = len(sample) + 2
    zeros = np.arange(0, n, 3)
    zero_key = t[zeros] * big + rank[zeros + 1]
    zo = np.argsort(zero_key, kind="stable")
    zeros, zero_key = zeros[zo], zero_key[zo]
    is_one = sorted_sample % 3 == 1
    one, two = sorted_sample[is_one], sorted_sample[~is_one]
    below = np.searchsorted(t[one] * big + rank[one + 1], zero_key)
    wide = s.max() + 2
    # One name for two places: every key stays below the square of the length.
    pair = np.unique(np.concatenate([t[two] * wide + t[two + 1], t[zeros] * wide + t[zeros + 1]]), return_inverse=True)[1].astype(np.int64)
    below += np.searchsorted(pair[: len(two)] * big + rank[two + 2], pair[len(two) :] * big + rank[zeros + 2])
    out = np.empty(n, np.int64)
    at = below + np.arange(len(zeros))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zeros, sorted_sample
    return out


def anchor_runs(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first start in the text, number of starts, anchor hash) of the runs of string starts with one anchor."""
    n, a = len(data), 0
    doc_of_end = off[1:]
    while a + LENGTH <= n:
        z = min(n, a + SEGMENT + LENGTH - 1)
        d = data[a:z]
        m = len(d) - LENGTH + 1
        sums = bt.prefix_sums(d)
        at = np.arange(len(d) - GRAM + 1)
        h = bt.span_hashes(sums, at, at + GRAM)
        v = (h & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
        w = 1
        while 2 * w <= STARTS:
            v = np.minimum(v[: len(v) - w], v[w:])
            w *= 2
        v = np.minimum(v[:m], v[STARTS - w : STARTS - w + m])
        anchor = (v & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.arange(a, a + m)
        doc = np.searchsorted(doc_of_end, starts, "right")
        ok = starts + LENGTH <= off[np.minimum(doc + 1, len(off) - 1)]
        starts, doc, anchor = starts[ok], doc[ok], anchor[ok]
        if len(starts):
            head = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0) | (np.diff(starts) != 1)]))
            yield doc[head], starts[head] - off[doc[head]], np.diff(np.append(head, len(starts))), h[anchor[head]]
        a += SEGMENT


def repeated_strings(runs: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(document, start, number of starts) of strings in runs (document, start, bytes) that are not the earliest of their class.

    The runs are in order of document and start. Strings that begin in different runs at the same place
    of the same document do not occur.
    """
    size = np.array([len(r[2]) for r in runs])
    s = np.frombuffer(b"".join(r[2] + b"\0" for r in runs), np.uint8).astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(size + 1)])
    s[first[1:] - 1] = 0
    sa = suffix_array(s)
    run = np.searchsorted(first, sa, "right") - 1
    ok = sa + LENGTH <= first[run] + size[run]
    sa, run = sa[ok], run[ok]
    # Eight bytes at once; no valid string reaches a separator.
    b = np.concatenate([s, np.zeros(8, np.int64)]).astype(np.uint64) & np.uint64(0xFF)
    word = np.zeros(len(s), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | ((b[k : k + len(s)] - np.uint64(1)) & np.uint64(0xFF))
    same = np.ones(len(sa) - 1, bool) if len(sa) else np.zeros(0, bool)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= word[sa[:-1] + k] == word[sa[1:] + k]
    cls = np.concatenate([[0], np.cumsum(~same)])[: len(sa)]
    order = np.lexsort((sa, cls))  # places in the joined bytes are in order of document and start
    sa, cls, run = sa[order], cls[order], run[order]
    later = np.concatenate([[False], cls[1:] == cls[:-1]])[: len(sa)]
    sa, run = sa[later], run[later]
    order = np.argsort(sa)
    sa, run = sa[order], run[order]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(sa) != 1) | (np.diff(run) != 0)])) if len(sa) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(sa)))
    return [(runs[r][0], runs[r][1] + int(p - first[r]), int(c)) for p, r, c in zip(sa[head], run[head].tolist(), count, strict=True)]


def repeats(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Covered (document, start, end) among runs, and the rows of the earliest of each distinct run."""
    covered, kept, seen = [], [], {}
    order = np.lexsort((starts, docs))
    for i in order.tolist():
        if seen.setdefault(texts[i], i) == i:
            kept.append(i)
        else:
            covered.append((int(docs[i]), int(starts[i]), int(starts[i]) + len(texts[i])))
    return covered, np.array(kept, np.int64)


def split_run(text: bytes, level: int) -> Iterator[tuple[int, int, int]]:
    """(first start, number of starts, key) of the parts of a run whose strings share their least gram of that level."""
    sums = bt.prefix_sums(np.frombuffer(text, np.uint8))
    at = np.arange(len(text) - GRAM + 1)
    h = bt.mix(bt.span_hashes(sums, at, at + GRAM) + bt.mix(np.array([level + 1], np.uint64)))
    key = np.lib.stride_tricks.sliding_window_view(h, STARTS).min(1)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    yield from zip(head.tolist(), np.diff(np.append(head, len(key))).tolist(), key[head].tolist(), strict=True)


def compare_runs(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, texts: list[bytes], level: int = 0) -> list[tuple[int, int, int]]:
    """Covered (document, start, end) among all runs of some anchors."""
    covered, kept = repeats(hashes, docs, starts, texts)
    h = hashes[kept]
    kept = kept[np.argsort(h, kind="stable")]
    edge = np.append(np.flatnonzero(np.diff(hashes[kept], prepend=hashes[kept[0]] + np.uint64(1))), len(kept)) if len(kept) else []
    batch: list[int] = []
    size = 0

    def done() -> None:
        nonlocal size
        batch.sort(key=lambda i: (docs[i], starts[i]))
        covered.extend((d, s, s + c + LENGTH - 1) for d, s, c in repeated_strings([(int(docs[i]), int(starts[i]), texts[i]) for i in batch]))
        batch.clear()
        size = 0

    for a, z in zip(edge[:-1], edge[1:], strict=True):
        if z - a > 1:
            group = kept[a:z].tolist()
            if level < LEVELS and sum(len(texts[i]) for i in group) > SPLIT:
                cut = [(k, docs[i], starts[i] + f, texts[i][f : f + c + LENGTH - 1]) for i in group for f, c, k in split_run(texts[i], level)]
                k, d, s, t = zip(*cut, strict=True)
                covered += compare_runs(np.array(k, np.uint64), np.array(d, np.int64), np.array(s, np.int64), list(t), level + 1)
                continue
            batch += group
            size += sum(len(texts[i]) for i in group)
            if size > 500_000:
                done()
    if batch:
        done()
    return covered


def _blob_rows(part: np.ndarray, cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each partition with the bytes of its entries of each column."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    out = [pa.array(part[edge[:-1]], pa.int64())]
    for c in cols:
        c = c[order]
        out.append(pa.array([c[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["part", *names])


def spans(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(__id, spans) with the covered spans of docs(doc_id, text) that hold repeated strings: pairs of 64-bit start and end.

    packed has the same texts, compressed, as __id and __text. Its shuffle serves this plan and the caller's.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = scratch.parts(spark, total, 4 << 20)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in bt.small(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for rows, data, off in bt.chunks(b.column(0), b.column(1)):
                for doc, start, count, h in anchor_runs(data, off):
                    held.append((h, ids[rows[doc]], start.astype(np.int64), count.astype(np.uint8)))
                    size += len(h)
                if size > 2_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        return _blob_rows((cols[0] % np.uint64(n_parts)).astype(np.int64), cols, ["h", "doc", "start", "count"])

    def seen_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, "part"):
            part = b.column("part").to_numpy()
            for p in np.unique(part):
                own = b.filter(pa.array(part == p))
                h, doc, start, count = (np.frombuffer(b"".join(own.column(c).to_pylist()), k) for c, k in (("h", np.uint64), ("doc", np.int64), ("start", np.int64), ("count", np.uint8)))
                inv, c = np.unique(h, return_inverse=True, return_counts=True)[1:]
                i = np.flatnonzero(c[inv] > 1)
                yield pa.RecordBatch.from_arrays([pa.array(doc[i], pa.int64()), pa.array(start[i], pa.int64()), pa.array(count[i].astype(np.int16), pa.int16()), pa.array(h[i].view(np.int64), pa.int64())], ["doc_id", "start", "count", "h"])

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, "doc_id"):
            ids, start, count, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "count", "h"))
            edge = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids))
            out = [(int(ids[a]), start[a:z].tobytes(), count[a:z].tobytes(), h[a:z].tobytes()) for a, z in zip(edge[:-1], edge[1:], strict=True)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "start", "count", "h"])

    runs = docs.mapInArrow(anchors, "part long, h binary, doc binary, start binary, count binary").repartition(n_parts, "part").sortWithinPartitions("part")
    runs = runs.mapInArrow(seen_again, "doc_id long, start long, count short, h long").repartition(n_parts, "doc_id").sortWithinPartitions("doc_id")
    asked = scratch.save(runs.mapInArrow(by_doc, "doc_id long, start binary, count binary, h binary"), "runs")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, start, own, size = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hh, dd, ss = np.array(h, np.int64).view(np.uint64), np.array(doc, np.int64), np.array(start, np.int64)
            covered, kept = repeats(hh, dd, ss, own)
            part = (hh[kept] % np.uint64(n_parts)).astype(np.int64)
            order = kept[np.argsort(part, kind="stable")]
            part = np.sort(part)
            edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            rows = [(int(part[a]), hh[i].tobytes(), dd[i].tobytes(), ss[i].tobytes(), np.array([len(own[k]) for k in i], np.int64).tobytes(), _zip(b"".join(own[k] for k in i)), None) for a, z in zip(edge[:-1], edge[1:], strict=True) if len(i := order[a:z])]
            if covered:
                rows.append((int(covered[0][0]) % n_parts, None, None, None, None, None, np.array(covered, np.int64).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "h", "doc", "start", "size", "bytes", "covered"])
            for x in (h, doc, start, own):
                x.clear()

        for b in bt.small(batches):
            for d, t, ss, cc, hh in zip(*(b.column(c).to_pylist() for c in ("__id", "__text", "__start", "__count", "__h")), strict=True):
                data = _unzip(t)
                s, c = np.frombuffer(ss, np.int64).tolist(), np.frombuffer(cc, np.int16).tolist()
                h += np.frombuffer(hh, np.int64).tolist()
                doc += [d] * len(s)
                start += s
                own += [data[i : i + k + LENGTH - 1] for i, k in zip(s, c, strict=True)]
                size += len(s)
                if size > 200_000:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, "part"):
            part = b.column("part").to_numpy()
            for p in np.unique(part):
                own = b.filter(pa.array(part == p))
                col = {c: b"".join((_unzip(x) if c == "bytes" else x) for x in own.column(c).to_pylist() if x) for c in ("h", "doc", "start", "size", "bytes", "covered")}
                h, doc, start, size = np.frombuffer(col["h"], np.uint64), *(np.frombuffer(col[c], np.int64) for c in ("doc", "start", "size"))
                end = np.cumsum(size)
                covered = compare_runs(h, doc, start, [col["bytes"][z - k : z] for z, k in zip(end.tolist(), size.tolist(), strict=True)])
                out = np.concatenate([np.frombuffer(col["covered"], np.int64).reshape(-1, 3), np.array(covered, np.int64).reshape(-1, 3)])
                out = out[np.lexsort((out[:, 1], out[:, 0]))]
                # Spans of a document that touch become one.
                if len(out):
                    reach = np.maximum.accumulate(out[:, 2] + (np.searchsorted(np.unique(out[:, 0]), out[:, 0]) << 40)) & ((1 << 40) - 1)
                    head = np.flatnonzero(np.concatenate([[True], (np.diff(out[:, 0]) != 0) | (out[1:, 1] > reach[:-1])]))
                    out = np.stack([out[head, 0], out[head, 1], reach[np.append(head[1:], len(out)) - 1]], 1)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k], pa.int64()) for k in range(3)], ["doc_id", "start", "end"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, "doc_id"):
            ids, start, end = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "end"))
            both = np.stack([start, end], 1)
            edge = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[edge[:-1]], pa.int64()), pa.array([both[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["__id", "__spans"])

    asked = asked.select(F.col("doc_id").alias("__id"), F.col("start").alias("__start"), F.col("count").alias("__count"), F.col("h").alias("__h"))
    found = packed.join(asked, "__id").mapInArrow(texts, "part long, h binary, doc binary, start binary, size binary, bytes binary, covered binary")
    found = found.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(compare, "doc_id long, start long, end long")
    return found.repartition(n_parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(pack, "__id long, __spans binary")


def covered_mask(n: int, packed: bytes | None) -> np.ndarray:
    """Which of n bytes are covered."""
    d = np.zeros(n + 1, np.int64)
    if packed:
        s = np.frombuffer(packed, np.int64).reshape(-1, 2)
        np.add.at(d, s[:, 0], 1)
        np.add.at(d, s[:, 1], -1)
    return np.cumsum(d)[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text, which take the place of columns of those names.

    Bytes are removed as the module says; kept_text holds what is left, keeping a whole character where
    a cut falls inside one. A null text is empty, and its kept_text null. Texts shorter than LENGTH keep
    all. Rows with one id are ordered by a hash of their text, equal ones arbitrarily; rows with a null
    id come last. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")]
    docs = docs.select(*names)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        docs = docs.withColumn("__id", F.col(id_col).cast("long"))
    else:  # number the rows in their order
        # A sorted table's partitions are in order: the partition's number, then the row's place in it.
        ordered = docs.sort(F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(text_col))
        docs = scratch.save(ordered.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    plain = docs.select(F.col("__id").alias("doc_id"), F.col(text_col).alias("text"))
    others = [c for c in names if c != text_col]
    kind = StructType([*(f for f in docs.schema if f.name in others), StructField("__id", LongType(), False), StructField("__text", BinaryType())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            text = [None if t is None else _zip(t.encode()) for t in b.column(len(others) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others) + 1], pa.array(text, pa.binary())], [*others, "__id", "__text"])

    # An id that cannot be null, and no filter: both joins read one shuffle of the texts.
    packed = docs.select(*others, "__id", text_col).mapInArrow(squeeze, kind)
    found = spans(plain.where("octet_length(text) >= %d" % LENGTH), packed)
    own = packed.join(found, "__id", "left").select(*others, "__text", "__spans")
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            out = []
            texts = [None if t is None else _unzip(t) for t in b.column("__text").to_pylist()]
            for t, s in zip(texts, b.column("__spans").to_pylist(), strict=True):
                data = t or b""
                if not s:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), None if t is None else data.decode()))
                    continue
                gone, raw = covered_mask(len(data), s), np.frombuffer(data, np.uint8)
                edges = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                # A character goes only if all its bytes do.
                head = (raw & 0xC0) != 0x80
                keep = np.add.reduceat(~gone, np.flatnonzero(head)) > 0
                text = raw[keep[np.cumsum(head) - 1]].tobytes().decode()
                out.append((len(data), int(gone.sum()), edges, hashlib.sha256(raw[~gone].tobytes()).hexdigest(), text))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array([None if t is None else t.decode() for t in texts], pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*others, text_col, *extra])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in [*others, text_col] for f in docs.schema if f.name == c) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return own.mapInArrow(cut, schema).select(*names, *extra)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
