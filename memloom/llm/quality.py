"""Quality rules by distribution divergence.

Each language of the corpus has two reference histograms, over all its labelled rows: character
classes, and its most common words with one bin for all others. A document is compared with every
language by Jensen-Shannon distance (base 2, 0 to 1) and fails if it is too far even from its nearest
language in either histogram. Histograms of few words are noise, so each comparison has a minimum length.

Too far is judged by its peers, the documents that pass the base rules, have the same nearest language
and as many words to the power of two below: above their median by ``SPREADS`` times their median
absolute deviation, and by ``MARGIN`` at least. Where fewer than ``PEERS`` are alike, those of the
language's other lengths count, too, and then all. Medians come from counts of distances in thousandths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from . import scratch

COMMON = 64
MIN_CLASS_WORDS, MIN_COMMON_WORDS = 10, 80
SPREADS, MARGIN, PEERS, BINS = 12.0, 0.1, 50, 1000
#: Words a task counts before it hands them on.
HELD_WORDS = 300_000

CLASSES = 7  # lower, upper, digit, space, other letter, sentence mark, symbol
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[192:] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:192] = CLASSES  # the rest of a character
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def class_counts(data: np.ndarray) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(_CLASS[data], minlength=CLASSES + 1)[:CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p to the histogram q; an empty row is at distance 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        total = p.sum(-1, keepdims=True)
        p = np.where(total > 0, p / total, 0)
        q = q / q.sum()
        m = (p + q) / 2
        half = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.where(total[..., 0] > 0, np.sqrt(np.clip(half / 2, 0, 1)), 1.0)


def base_rules(text: str, data: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    off = np.array([0, len(data)])
    starts, ends, _ = bt.words(data, off)
    n = len(starts)
    chars = int(((data & 0xC0) != 0x80).sum() - np.isin(data, (32, 9, 10, 11, 12, 13)).sum())
    symbols = int(_SYMBOL[data].sum())
    dup = 0
    if "\n" in text:
        seen = Counter(x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
        dup = sum(seen.values()) - len(seen)
    repeat = 0
    if n >= 6:
        w = bt.window_hashes(bt.span_hashes(bt.prefix_sums(data), starts, ends), 5)
        _, inv, c = np.unique(w, return_inverse=True, return_counts=True)
        again = (c[inv] > 1).astype(np.int64)
        if again.any():
            d = np.zeros(n + 1, np.int64)
            d[: len(w)] += again
            d[5 : 5 + len(w)] -= again
            repeat = int((np.cumsum(d)[:n] > 0).sum())
    return n, chars, symbols, dup, repeat


def _tokens(text: str) -> list[str]:
    """Lower-case words without marks at their ends."""
    return [w for w in (x.strip(".,;:?!'\"()\x00") for x in text.lower().split()) if w]


def fit(docs: DataFrame, common: int = COMMON) -> dict[str, dict]:
    """Reference histograms by language: at most `common` words and the classes of each come to the driver.

    Words are counted over all rows; equal counts rank by word. Rows with a null text or lang teach nothing.
    """
    rows = docs.select("text", "lang").where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])
            sums.clear()

        for b in bt.small(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c, own = sums.setdefault(lang, Counter()), _tokens(text)
                c.update(own)
                c["\x00all"] += len(own)
                for k, v in enumerate(class_counts(np.frombuffer(text.encode(), np.uint8)).tolist()):
                    c[f"\x00{k}"] += v
            if sum(map(len, sums.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    sums = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = scratch.save(sums, "words")
    mark = F.col("word").startswith("\x00")
    # Each task hands on a language's first `common` words alone.
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = sums.where(~mark).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= common).drop("rank")
    refs: dict[str, dict] = {}
    for r in words.unionByName(sums.where(mark)).collect():
        refs.setdefault(r["lang"], {})[r["word"]] = r["n"]
    out = {}
    for lang, c in refs.items():
        own = sorted(w for w in c if w[0] != "\x00")
        rest = c["\x00all"] - sum(c[w] for w in own)
        if c["\x00all"]:
            out[lang] = {"words": own, "common": [c[w] for w in own] + [rest], "classes": [c[f"\x00{k}"] for k in range(CLASSES)]}
    return out


def verdicts(text: str, data: np.ndarray, refs: dict[str, dict]) -> tuple[float | None, float | None, str | None]:
    """Distance of character classes and of common words to the nearest language, and that language."""
    tokens = Counter(_tokens(text))
    n = sum(tokens.values())
    p = class_counts(data).astype(float)
    best = (None, None, None)
    for lang in sorted(refs):
        r = refs[lang]
        hits = [tokens[w] for w in r["words"]]
        x = float(js_distance(p, np.asarray(r["classes"], float)))
        y = float(js_distance(np.array([*hits, n - sum(hits)], float), np.asarray(r["common"], float)))
        if best[2] is None or x + y < best[0] + best[1]:
            best = (x, y, lang)
    return best


def _limit(bins: dict[int, int], spreads: float, margin: float) -> float:
    """Median of distances in thousandths, plus the allowed spread."""

    def median(c: dict[int, int]) -> int:
        need, at = (sum(c.values()) + 1) // 2, 0
        for k in sorted(c):
            at += c[k]
            if at >= need:
                return k
        return 0

    mid = median(bins)
    off: dict[int, int] = {}
    for k, n in bins.items():
        off[abs(k - mid)] = off.get(abs(k - mid), 0) + n
    return mid / BINS + max(spreads * median(off) / BINS, margin)


def limits(measures: DataFrame, spreads: float = SPREADS, margin: float = MARGIN, peers: int = PEERS) -> list[tuple[str, int, float, float]]:
    """(nearest, octave, limit of classes, limit of common words); at most BINS counts a language and octave come to the driver."""
    good = measures.where("not base_failed and nearest is not null")
    out: dict[tuple, list[float]] = {}
    for which, col in enumerate(("class_distance", "common_distance")):
        counts = good.groupBy("nearest", "octave", F.floor(F.col(col) * BINS).cast("int").alias("bin")).count().collect()
        by: dict[tuple, dict[int, int]] = {}
        for r in counts:
            for k in ((r.nearest, r.octave), (r.nearest,), ()):
                c = by.setdefault(k, {})
                c[r.bin] = c.get(r.bin, 0) + r["count"]
        for k in by:
            if len(k) == 2:
                enough = next((x for x in (k, k[:1]) if sum(by[x].values()) >= peers), ())
                out.setdefault(k, [0.0, 0.0])[which] = _limit(by[enough], spreads, margin)
    return [(*k, *v) for k, v in out.items()]


def apply_rules(docs: DataFrame, refs: dict[str, dict], spreads: float = SPREADS, margin: float = MARGIN, peers: int = PEERS, min_class: int = MIN_CLASS_WORDS, min_common: int = MIN_COMMON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of measures and verdicts for each row of docs.

    A null text has no words and fails the base rules. A document with fewer than min_common words is
    not judged by common words, with fewer than min_class by neither. Equally near languages: the first
    by name. Without references only the base rules judge. Repeated rows give a row each; an empty table
    an empty result; other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "nearest", "octave"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                data = np.frombuffer(t.encode(), np.uint8)
                m = base_rules(t, data)
                out.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0], *verdicts(t, data, refs), m[0].bit_length()))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.float64()] * 2 + [pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    measures = scratch.save(docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, common_distance double, nearest string, octave int"), "quality")
    found = docs.sparkSession.createDataFrame(limits(measures, spreads, margin, peers), "nearest string, octave int, max_class double, max_common double")
    far = (F.col("n_words") >= min_class) & (F.col("class_distance") > F.col("max_class")) | (F.col("n_words") >= min_common) & (F.col("common_distance") > F.col("max_common"))
    out = measures.join(F.broadcast(found), ["nearest", "octave"], "left")  # a row for each language and octave
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return out.select(F.col("doc_id").alias(id_col), *names[1:7], kept.alias("kept"), "class_distance", "common_distance", "nearest", "max_class", "max_common")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs, fit(docs))
