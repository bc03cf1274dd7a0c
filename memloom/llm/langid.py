"""Language identification by rank-order n-gram profiles.

A profile lists a text's most frequent n-grams of one to three characters, letters lower-cased and
every run of other characters one space. A text gets the language whose profile has the smallest
out-of-place distance: the sum, over the text's n-grams, of the difference of ranks, or the length of
a profile where the language has no such n-gram.

Profiles are fitted on a bounded sample: the ``per_lang`` labelled rows of each language with the
smallest hash of their id. Prediction covers every row and reads the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bytetext as bt

PROFILE, TEXT_PROFILE, PER_LANG = 400, 300, 3000
UNKNOWN = "und"
_tables: dict[str, np.ndarray] = {}


def _codes(text: str) -> np.ndarray:
    """Lower-case code points with one space for each run of other characters, and at both ends; empty if no letter."""
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((0xD800 > c and chr(c).isalpha() or c > 0xDFFF and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _tables["letter"][a]
    if not letter.any():
        return np.zeros(0, np.int64)
    a = np.concatenate([[32], np.where(letter, a, 32), [32]]).astype(np.int64)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    return a[keep]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of one to three characters and their counts, without the lone space."""
    a = _codes(text)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = a[:-1] << 21 | a[1:]
    three = two[:-1] << 21 | a[2:]
    out = [np.unique(x, return_counts=True) for x in (a[a != 32], two, three)]
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent keys, by falling count, then by key."""
    if len(keys) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """Language profiles, each a list of n-grams by rank."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(by_lang), size
        self.keys, self.ranks = [], []
        for lang in self.langs:
            k = np.asarray(by_lang[lang], np.int64)
            order = np.argsort(k)
            self.keys.append(k[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ties go to the first language by name."""
        own = ranked(*ngrams(text), TEXT_PROFILE) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        best, least = UNKNOWN, np.inf
        for lang, keys, ranks in zip(self.langs, self.keys, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            d = np.where(keys[at] == own, np.abs(ranks[at] - np.arange(len(own))), self.size).sum()
            if d < least:
                best, least = lang, d
        return best, float(1 - min(1.0, least / (self.size * len(own))))


def fit(rows: DataFrame, per_lang: int = PER_LANG, size: int = PROFILE, id_col: str = "doc_id") -> Profiles:
    """Profiles of the languages of rows (id, text, lang); rows with a null id, text or lang teach nothing.

    A language has its rows of smallest id hash, then of smallest id, at most per_lang. Rows that repeat
    a chosen id all teach.
    """
    rows = rows.select(F.col(id_col).alias("id"), "text", "lang").where("id is not null and text is not null and lang is not null")
    # Only so many small hashes reach a language's one task; four times the sample, so that it is full all but surely.
    sizes = rows.groupBy("lang").agg(F.count("lang").alias("n"))
    bound = F.lit(float(1 << 63)) * F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.col("n"))
    likely = rows.select("id", "lang").join(sizes, "lang").where(F.xxhash64("id").cast("double") / 2 + float(1 << 62) <= bound)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = likely.select("id", "lang").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_lang).select("id", "lang").distinct()
    rows = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi")  # at most per_lang rows a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for b in bt.small(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, {})
                for k, c in zip(*(x.tolist() for x in ngrams(text)), strict=True):
                    own[k] = own.get(k, 0) + c
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], ["lang", "gram", "n"])

    grams = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    out: dict[str, list] = {}
    for r in grams.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= size).collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({lang: [g for _, g in sorted(x)] for lang, x in out.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, which take the place of columns of those names.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text where no
    language was learned. Nulls in other columns, repeated rows and empty tables pass through.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    schema = StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            out = [profiles.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit(docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
