"""Language-model scores by Katz backoff over words.

Counts of the n-grams up to ``ORDER`` words come from all training rows, those seen once included.
Good-Turing discounts counts up to ``GT_MAX``. What that frees after a history goes to the words never
seen after it, by a weight that makes every distribution sum to one. A token whose n-gram is unseen is
scored by the shorter one, recursively, down to single words and one class of unknown words.

Rows fall into blocks, parts of the scan's partitions, written once as word numbers. The n-gram tables
are partitioned by ranges of the n-grams' hashes. Level by level a block asks for the counts of its
distinct n-grams and gets them back by place, without keys. It does not ask for an n-gram of which a
part stands in no other block. Then each n-gram's first block sends its share of its history's sums, and
the blocks that need a history's weight get it. Histories that no token outside training has, and that
are too rare to be undiscounted, are not sent. The text is parsed once and never shuffled.

Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from . import scratch
from .components import sorted_groups

GT_MAX, ORDER = 5, 3
START, END = np.uint64(0x5354415254535441), np.uint64(0x454E44454E44454E)
BLOCK_BYTES = 8 << 20
STATS = GT_MAX + 3  # counts of counts 1 to GT_MAX + 1, tokens, types
BLOCKS = "blk long, doc_id array<long>, train binary, n binary, hash binary, tok binary"


def _zip(a: np.ndarray) -> bytes:
    """An array with its bytes transposed, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unzip(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _zip_keys(a: np.ndarray) -> bytes:
    """Keys as differences, whose high bytes are zero where keys rise."""
    return _zip(np.diff(a, prepend=np.uint64(0)))


def _unzip_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, np.uint64), dtype=np.uint64)


def _zip_values(a: np.ndarray) -> bytes:
    """Numbers of which many are equal: as places in the list of their values, where that is shorter."""
    u, at = np.unique(a, return_inverse=True)
    coded = np.uint32(len(u)).tobytes() + u.tobytes() + _zip(at.astype(np.uint32))
    return min(b"\1" + coded, b"\0" + _zip(a), key=len)


def _unzip_values(b: bytes) -> np.ndarray:
    if b[:1] == b"\0":
        return _unzip(b[1:], np.float64)
    z = 5 + 8 * int(np.frombuffer(b[1:5], np.uint32)[0])
    return np.frombuffer(b[5:z], np.float64)[_unzip(b[z:], np.uint32)]


def discounts(n: list[int]) -> np.ndarray:
    """Factors of counts 0 to GT_MAX, and 1 for all larger ones, from n[r - 1] n-grams of count r.

    Good-Turing; where the counts of counts give no factor in (0, 1), (r - 0.5) / r.
    """
    d = np.ones(GT_MAX + 2)
    rest = (GT_MAX + 1) * n[GT_MAX] / n[0] if n[0] else 1.0
    for r in range(1, GT_MAX + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if n[r - 1] and rest < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    d[0] = 0.0
    return d


class Model:
    """The numbers that every task needs: totals, and discounts by level."""

    def __init__(self, stats: dict[int, list[int]], n_docs: int):
        self.n, self.v = stats[1][GT_MAX + 1], stats[1][GT_MAX + 2]
        self.docs = n_docs
        self.d = {k: discounts(s) for k, s in stats.items()}
        freed = sum((1 - self.d[1][r]) * r * stats[1][r - 1] for r in range(1, GT_MAX + 1))
        # The class of unknown words has what is freed, or where nothing is, the share of one more token.
        self.unknown = freed / self.n if freed else 1 / (self.n + 1)
        self.scale = 1.0 if freed else self.n / (self.n + 1)

    def mass(self, level: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.d[level][np.minimum(c, GT_MAX + 1)] * c

    def p1(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.mass(1, c) * (self.scale / self.n if self.n else 0.0), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


class Level:
    """The distinct n-grams of one length in a block, in order of their keys.

    at: of each token, the number of the n-gram that it ends; prefix: of each n-gram, the history, a number
    of the level below, or one past its last for the history that is only starts; suffix: the n-gram
    without its first word; key: its hash; own: its occurrences in training rows; held: whether it
    stands in a row outside training.
    """

    def __init__(self, at: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, last: np.ndarray, key: np.ndarray, train: np.ndarray):
        order = np.argsort(key)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.prefix, self.suffix, self.last, self.key = place[at], prefix[order], suffix[order], last[order], key[order]
        self.own = np.bincount(self.at[train], minlength=len(key))
        self.held = np.bincount(self.at[~train], minlength=len(key)) > 0
        self.start = bt.mix(START + np.uint64(1))
        self.count = self.own
        self.first = self.own > 0  # whether this block sends the n-gram's share
        self.abroad = self.held  # whether any row outside training has it

    def set(self, got: np.ndarray, mask: np.ndarray) -> None:
        """Answers for the n-grams of mask; the block alone has the others."""
        self.count, self.first, self.abroad = self.own.astype(np.int64), self.own > 0, self.held.copy()
        self.count[mask], self.first[mask], self.abroad[mask] = got >> 2, got & 1 > 0, got & 2 > 0


class Block:
    """A block's documents, and its n-grams by level."""

    def __init__(self, ids: pa.Array, train: bytes, n: bytes, hashes: bytes, tok: bytes):
        self.ids = ids
        self.train, self.n = np.frombuffer(train, bool), _unzip(n, np.int64)
        self.hash, self.tok = _unzip_keys(hashes), _unzip(tok, np.uint32).astype(np.int64)
        self.learn = np.repeat(self.train, self.n)
        self.head = np.cumsum(self.n) - self.n
        v = np.arange(len(self.hash))
        self.levels = [Level(self.tok, np.zeros(len(v), np.int64), v, v, self.hash, self.learn)]

    def grow(self) -> Level:
        """The next level."""
        low = self.levels[-1]
        m, v = len(low.key), len(self.hash)
        before = np.empty(len(self.tok), np.int64)
        before[1:] = low.at[:-1]
        before[self.head] = m
        _, rep, at = np.unique(before * v + self.tok, return_index=True, return_inverse=True)
        prefix, last = before[rep], self.tok[rep]
        key = bt.mix(np.append(low.key, low.start)[prefix] * bt._MUL + bt.mix(self.hash[last]))
        out = Level(at, prefix, low.at[rep], last, key, self.learn)
        out.start = bt.mix(low.start + np.uint64(1))
        self.levels.append(out)
        return out

    def wanted(self, n_docs: int) -> np.ndarray:
        """Which n-grams of the last level to ask for: not those of which the history or the suffix stands in this block alone."""
        top, low = self.levels[-1], self.levels[-2]
        if len(self.levels) == 2:
            return np.ones(len(top.key), bool)
        alone = np.append((low.own == low.count) & ~low.abroad, False)
        never = np.append(low.count == 0, n_docs == 0)
        return ~(alone[top.prefix] | alone[top.suffix] | never[top.prefix] | never[top.suffix])


def _parts(key: np.ndarray, n_parts: int) -> np.ndarray:
    """Ranges of keys, in their order."""
    return (((key >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)


def _slices(key: np.ndarray, n_parts: int) -> Iterator[tuple[int, slice]]:
    """(part, slice) of sorted keys."""
    part = _parts(key, n_parts)
    edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, z)


ASK = "part long, level int, blk long, keys binary, counts binary, n array<long>"
ANSWER = "blk long, level int, part long, found binary, n array<long>"


def _ask(blk: int, level: int, lv: Level, mask: np.ndarray, n_parts: int) -> Iterator[tuple]:
    """Rows of ASK: a block's n-grams of mask, and the counts of counts of the others."""
    key, code = lv.key[mask], (lv.own * 2 + lv.held)[mask]
    for p, s in _slices(key, n_parts):
        yield p, level, blk, _zip_keys(key[s]), _zip(code[s]), None
    rest = lv.own[~mask]
    rest = rest[rest > 0]
    if len(rest):
        yield blk % n_parts, level, blk, None, None, [*np.bincount(np.minimum(rest, GT_MAX + 2), minlength=GT_MAX + 3)[1 : GT_MAX + 2].tolist(), int(rest.sum()), len(rest)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_ASK = pa.schema([("part", pa.int64()), ("level", pa.int32()), ("blk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.list_(pa.int64()))])
_ANSWER = pa.schema([("blk", pa.int64()), ("level", pa.int32()), ("part", pa.int64()), ("found", pa.binary()), ("n", pa.list_(pa.int64()))])


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of equal part and level."""
    part, level = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "level"))
    edge = np.append(np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(level, prepend=-1) != 0)), b.num_rows)
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield b.slice(a, z - a)


def count_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ANSWER to rows of ASK: count * 4 + (some row outside training has it) * 2 + (the asker is the first that learned it)."""
    for group in sorted_groups(batches, "part"):
        for b in _runs(group):
            out, level = [], b.column("level")[0].as_py()
            stats = np.zeros(STATS, np.int64)
            for x in b.column("n").to_pylist():
                stats += np.array(x if x else [0] * STATS, np.int64)
            rows = [i for i, x in enumerate(b.column("keys")) if x.is_valid]
            if rows:
                keys = [_unzip_keys(b.column("keys")[i].as_py()) for i in rows]
                code = np.concatenate([_unzip(b.column("counts")[i].as_py(), np.int64) for i in rows])
                size = np.array([len(x) for x in keys])
                u, inv = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(inv, code >> 1, len(u)).astype(np.int64)
                held = np.bincount(inv, code & 1, len(u)) > 0
                has = np.flatnonzero(code > 1)[::-1]
                first = np.full(len(u), -1, np.int64)
                first[inv[has]] = has
                found = total[inv] * 4 + held[inv] * 2 + (first[inv] == np.arange(len(inv)))
                stats[: GT_MAX + 1] += np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)[1 : GT_MAX + 2]
                stats[GT_MAX + 1 :] += [int(total.sum()), int((total > 0).sum())]
                end = np.cumsum(size)
                part = b.column("part")[0].as_py()
                out = [(b.column("blk")[i].as_py(), level, part, _zip(found[z - n : z]), None) for i, n, z in zip(rows, size.tolist(), end.tolist(), strict=True)]
            yield _batch([*out, (-1, level, b.column("part")[0].as_py(), None, stats.tolist())], _ANSWER)


SHARE = "part long, level int, blk long, keys binary, s1 binary, s2 binary, asked binary"
WEIGHT = "blk long, level int, part long, s1 binary, s2 binary"
_SHARE = pa.schema([("part", pa.int64()), ("level", pa.int32()), ("blk", pa.int64()), *((c, pa.binary()) for c in ("keys", "s1", "s2", "asked"))])
_WEIGHT = pa.schema([("blk", pa.int64()), ("level", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in ("s1", "s2"))])


def history_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the shares of each history, for the blocks that ask."""
    for group in sorted_groups(batches, "part"):
        for b in _runs(group):
            keys = [_unzip_keys(x) for x in b.column("keys").to_pylist()]
            inv = np.unique(np.concatenate(keys), return_inverse=True)[1]
            sums = [np.bincount(inv, np.concatenate([_unzip_values(x) for x in b.column(c).to_pylist()]))[inv] for c in ("s1", "s2")]
            end, level, part = np.cumsum([len(k) for k in keys]).tolist(), b.column("level")[0].as_py(), b.column("part")[0].as_py()
            out = []
            for i, (k, z) in enumerate(zip(keys, end, strict=True)):
                asked = np.flatnonzero(np.frombuffer(b.column("asked")[i].as_py(), bool)) + z - len(k)
                if len(asked):
                    out.append((b.column("blk")[i].as_py(), level, part, *(_zip_values(s[asked]) for s in sums)))
            yield _batch(out, _WEIGHT)


def _history(blk: Block, level: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Training occurrences of the histories of a level's n-grams (the start comes last), and whether rows outside training have them."""
    low = blk.levels[level - 2]
    return np.append(low.count, model.docs), np.append(low.abroad, True)


def shares(blk: Block, level: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s1, s2 of the histories of a level from the n-grams that this block sends, and which histories it sends.

    s1: what discounting frees; s2: the seen words' share of the shorter history's distribution, as
    probabilities at level 2 and as discounted counts above. No token backs off from a history that no
    row outside training has: of it only s1 may matter.
    """
    top, low = blk.levels[level - 1], blk.levels[level - 2]
    m = len(low.key) + 1
    own = top.first
    c, p = top.count[own], top.prefix[own]
    lower = model.p1(low.count[top.suffix[own]]) if level == 2 else model.mass(level - 1, low.count[top.suffix[own]])
    count, abroad = _history(blk, level, model)
    s1, s2 = (np.bincount(p, w, m) for w in (c - model.mass(level, c), lower))
    s2[~abroad] = 0
    return s1, s2, (s1 > 0) & (count > GT_MAX) | (s2 > 0)


def asked(blk: Block, level: int, model: Model) -> np.ndarray:
    """Which histories of a level this block needs: those where a token backs off, and those that may be undiscounted."""
    top, low = blk.levels[level - 1], blk.levels[level - 2]
    m = len(low.key) + 1
    count, _ = _history(blk, level, model)
    need = np.zeros(m, bool)
    need[top.prefix[top.at[blk.levels[-1].count[blk.levels[-1].at] == 0]]] = True
    least = np.full(m, np.iinfo(np.int64).max)
    seen = top.count > 0
    np.minimum.at(least, top.prefix[seen], top.count[seen])
    full = (least > GT_MAX) & (least < np.iinfo(np.int64).max)
    return (need | full) & (count > 0)


def score_tokens(blk: Block, model: Model, sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of each token's probability; sums has of each level's histories s1 and s2, and whether they were asked for."""
    log = np.zeros(len(blk.tok))
    open_ = np.arange(len(blk.tok))
    weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for level in range(2, len(blk.levels) + 1):
        s1, s2, known = sums[level]
        s0 = np.where(known, _history(blk, level, model)[0], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(s1 > 0, s1 / s0, 1 / (s0 + 1))
            keep = np.where((s0 > 0) & (s1 <= 0), s0 / (s0 + 1), 1.0)
            taken = s2
            if level > 2:  # by the history without its first word
                inner = np.append(blk.levels[level - 2].suffix, len(blk.levels[level - 3].key))
                taken = s2 * weights[level - 1][0][inner] / _history(blk, level - 1, model)[0][inner]
            back = np.where(s0 > 0, left / np.maximum(1 - taken, 1e-300), 1.0)
        weights[level] = keep, back
    for level in range(len(blk.levels), 1, -1):
        top = blk.levels[level - 1]
        keep, back = weights[level]
        gram = top.at[open_]
        c, h = top.count[gram], top.prefix[gram]
        seen = c > 0
        count = _history(blk, level, model)[0]
        log[open_[seen]] += np.log10(keep[h[seen]] * model.mass(level, c[seen]) / count[h[seen]])
        open_, h = open_[~seen], h[~seen]
        log[open_] += np.log10(back[h])
    log[open_] += np.log10(model.p1(blk.levels[0].count[blk.levels[0].at[open_]]))
    return log


def katz_scores(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, trained, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    train says which rows teach; null does not. A null text is empty: its end alone is scored and, in
    training, learned. Rows that repeat an id count and are scored each. Without training rows every
    token is unknown. A text is never split over blocks. Other columns are left out. An empty table
    gives an empty result.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(train, F.lit(False)).alias("train"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, i, base = 0, 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            train, n, h = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            u, tok, count = np.unique(h, return_inverse=True, return_counts=True)
            by = np.lexsort((u, -count))  # frequent words have small numbers
            number = np.empty(len(u), np.uint32)
            number[by] = np.arange(len(u), dtype=np.uint32)
            ids = pa.array([[y for x in held for y in x[0]]], pa.list_(pa.int64()))
            held.clear()
            blobs = (train.tobytes(), _zip(n.astype(np.int64)), _zip_keys(u[by]), _zip(number[tok]))
            return pa.RecordBatch.from_arrays([pa.array([base + i], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in blobs)], ["blk", "doc_id", "train", "n", "hash", "tok"])

        for b in bt.small(batches):
            learn, ids = b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1).to_pylist()
            for r, data, off in bt.chunks(b.column(1), b.column(2)):
                h, first = bt.word_hashes(bt.LOWER[data], off)
                held.append(([ids[k] for k in r.tolist()], learn[r], np.diff(first) + 1, np.insert(h, first[1:], END)))
                size += len(data)
                if size >= block_bytes:
                    yield flush()
                    size, i = 0, i + 1
        if held:
            yield flush()

    blocks = scratch.save(rows.mapInArrow(make_blocks, BLOCKS), "blocks")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = scratch.parts(spark, total, 8 << 20)

    def load(t: pa.Table) -> tuple[int, Block]:
        t = t.combine_chunks()
        return t.column("blk")[0].as_py(), Block(t.column("doc_id")[0].values, *(t.column(c)[0].as_py() for c in ("train", "n", "hash", "tok")))

    def recall(blk: Block, got: pa.Table, level: int, n_docs: int) -> Block:
        """Build the levels up to `level` and set the answers for them."""
        got = got.combine_chunks().sort_by([("level", "ascending"), ("part", "ascending")])
        levels = got.column("level").to_numpy()
        for k in range(1, level + 1):
            lv = blk.grow() if k > 1 else blk.levels[0]
            mask = blk.wanted(n_docs) if k > 1 else np.ones(len(lv.key), bool)
            own = got.filter(pa.array(levels == k)) if len(levels) else got
            lv.set(np.concatenate([np.zeros(0, np.int64), *(_unzip(x, np.int64) for x in own.column("found").to_pylist())]), mask)
        return blk

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches, 1):
            blk, block = load(pa.Table.from_batches([b]))
            for k in (1, 2):
                lv = block.levels[0] if k == 1 else block.grow()
                yield _batch(list(_ask(blk, k, lv, np.ones(len(lv.key), bool), n_parts)), _ASK)

    def answered(ask: DataFrame, level: int) -> DataFrame:
        return scratch.save(ask.repartition(n_parts, "part").sortWithinPartitions("part", "level", "blk").mapInArrow(count_tables, ANSWER), f"counts-{level}")

    n_docs = int(rows.where("train").count())
    answers = answered(blocks.mapInArrow(ask_first, ASK), 2)

    def met(got: DataFrame, f, schema: str) -> DataFrame:
        """f of each block and the rows of got for it."""
        return blocks.repartition(n_parts, "blk").groupBy("blk").cogroup(got.repartition(n_parts, "blk").groupBy("blk")).applyInArrow(f, schema)

    def ask_next(level: int):
        def run(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
            if not own.num_rows:
                return _batch_table([], _ASK)
            blk, block = load(own)
            lv = recall(block, got, level - 1, n_docs).grow()
            return _batch_table(list(_ask(blk, level, lv, block.wanted(n_docs), n_parts)), _ASK)

        return run

    for level in range(3, order + 1):
        answers = answers.unionByName(answered(met(answers.where("blk >= 0"), ask_next(level), ASK), level))

    sums = answers.where("blk < 0").select("level", F.posexplode("n")).groupBy("level", "pos").agg(F.sum("col").alias("n")).collect()  # STATS numbers a level
    stats = {k: [0] * STATS for k in range(1, order + 1)}
    for r in sums:
        stats[r["level"]][r["pos"]] = r["n"]
    model = Model(stats, n_docs)
    answers = answers.where("blk >= 0")

    def share(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _batch_table([], _SHARE)
        blk, block = load(own)
        recall(block, got, order, n_docs)
        out = []
        for level in range(2, order + 1):
            low = block.levels[level - 2]
            s1, s2, send = shares(block, level, model)
            ask = asked(block, level, model)
            key_ = np.append(low.key, low.start)
            at = np.flatnonzero(send | ask)
            at = at[np.argsort(key_[at])]
            s1[~send] = 0
            for p, cut in _slices(key_[at], n_parts):
                i = at[cut]
                out.append((p, level, blk, _zip_keys(key_[i]), _zip_values(s1[i]), _zip_values(s2[i]), ask[i].tobytes()))
        return _batch_table(out, _SHARE)

    sent = met(answers, share, SHARE).repartition(n_parts, "part").sortWithinPartitions("part", "level", "blk")
    weights = scratch.save(sent.mapInArrow(history_tables, WEIGHT), "weights")
    none = F.lit(None).cast("binary")
    got = answers.select("blk", "level", "part", "found", none.alias("s1"), none.alias("s2")).unionByName(weights.select("blk", "level", "part", none.alias("found"), "s1", "s2"))

    def evaluate(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        cols = [("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        if not own.num_rows:
            return pa.table([pa.array([], k) for _, k in cols], names=[c for c, _ in cols])
        _, block = load(own)
        is_count = got.column("found").is_valid()
        recall(block, got.filter(is_count), order, n_docs)
        got = got.filter(pc.invert(is_count)).combine_chunks().sort_by([("level", "ascending"), ("part", "ascending")])
        levels = got.column("level").to_numpy()
        sums = {}
        for level in range(2, order + 1):
            low = block.levels[level - 2]
            key_ = np.append(low.key, low.start)
            at = np.flatnonzero(asked(block, level, model))
            at = at[np.argsort(key_[at])]
            mine = got.filter(pa.array(levels == level)) if len(levels) else got
            full = []
            for c in ("s1", "s2"):
                x = np.zeros(len(key_))
                x[at] = np.concatenate([np.zeros(0), *(_unzip_values(y) for y in mine.column(c).to_pylist())])
                full.append(x)
            known = np.zeros(len(key_), bool)
            known[at] = True
            sums[level] = (*full, known)
        c = block.levels[0].count[block.levels[0].at]
        doc = np.repeat(np.arange(len(block.n)), block.n)
        known, base, score = (np.bincount(doc, x, len(block.n)) for x in (c > 0, model.base(c), score_tokens(block, model, sums)))
        out = [block.ids, pa.array(block.train), pa.array(block.n), pa.array(known.astype(np.int64)), pa.array(np.full(len(block.n), model.n), pa.int64()), pa.array(base), pa.array(score)]
        return pa.table(out, names=[c for c, _ in cols])

    schema = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met(got, evaluate, schema).withColumnRenamed("doc_id", id_col)


def _batch_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; held_out is null for a null id, which teaches nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return katz_scores(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
