"""Token counts of whole texts without making the id sequences.

A task cuts each text into pre-tokens, counts how often each occurs in the text, has the tokenizer
cut each distinct pre-token once, and joins those piece counts to the texts' frequencies. The join
runs inside the task against a table of at most ``MOST_KNOWN`` pre-tokens, so no row is shuffled;
a shuffled join would move about 12 bytes for each pre-token of each text, twice the input.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt

SPECIAL = "<|endoftext|>"
MOST_KNOWN = 400_000
_known: dict[str, dict[str, int]] = {}
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, once a worker, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _pattern():
    if "pattern" not in _loaded:
        import regex

        _loaded["pattern"] = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    return _loaded["pattern"]


def text_frequencies(text: str, path: str) -> tuple[Counter, int]:
    """Pre-token frequencies of a text, and how often the special token stands in it."""
    if text and max(text) >= "\U00010000":  # the library's tables of letters are older there than regex's
        cuts = tokenizer(path).pre_tokenizer.pre_tokenize_str

        def cut(run: str) -> list[str]:
            return [run[a:b] for _, (a, b) in cuts(run)]
    else:
        cut = _pattern().findall
    if SPECIAL not in text:
        return Counter(cut(text)), 0
    runs = text.split(SPECIAL)
    freq: Counter = Counter()
    for run in runs:
        freq.update(cut(run))
    return freq, len(runs) - 1


def counts(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text."""
    known, tok = _known.setdefault(path, {}), tokenizer(path)
    out = []
    for i in range(0, len(texts), 256):
        freqs = [text_frequencies(t, path) for t in texts[i : i + 256]]
        new = list({p for f, _ in freqs for p in f if p not in known})
        if len(known) + len(new) > MOST_KNOWN:
            known.clear()
            new = list({p for f, _ in freqs for p in f})
        for j in range(0, len(new), 4096):
            part = new[j : j + 4096]
            known.update(zip(part, (len(e.ids) for e in tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        out += [n + sum(known[p] * c for p, c in f.items()) for f, n in freqs]
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. Other
    columns of docs are left out, so their names never clash. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counts(texts, path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
