"""Words, hashes and lines of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_C1, _C2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = 0xD6E8FEB86659FD93
_INV = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * _C1
    x = x ^ (x >> U64(27))
    x = x * _C2
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        for k, b in enumerate((BASE, _INV)):
            a = np.full(m, b, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = BASE**i times the polynomial hash of data[i:j]."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=s[1:])
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    inv = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64) * _MUL)


def chunks(ids: pa.Array, texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, offsets) of runs of texts of at most `most` bytes, or of one longer text. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield np.arange(i, j), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of every text, or of its runs of solid bytes, and the number of each text's first word (one more entry than texts)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[data] if solid is None else solid
    head = np.zeros(n + 1, bool)
    head[off] = True
    head[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | head[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | head[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of each text's first word."""
    starts, ends, first = words(data, off)
    return span_hashes(prefix_sums(data), starts, ends), first


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` word hashes; windows may cross texts, the caller cuts there."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = np.full(n, U64(size))
    for j in range(size):
        x = mix(x * _MUL + h[j : j + n])
    return x


def shingle_sets(h: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    all_ = window_hashes(h, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(all_[a : b - size + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker holds few texts as objects; at the end it gives free memory back."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
