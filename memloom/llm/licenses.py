"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file is compared as a whole, by paragraphs, by lines and by sentences, so a header, a notice inside
other text and a licence file are each seen as one piece. A piece's TF-IDF vector over all its words,
unknown ones in its length, is compared with every template of ``license_texts``: an inverted index of
the templates' words gives each piece's known part, and only pieces whose known part could reach the
threshold meet the templates. A file takes the licence of its most similar piece. A file that is named
as a licence, or mostly covered by such pieces, speaks for its directory; a file without a licence
inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from . import scratch
from .license_texts import TEMPLATES, WEAK

LEAST, FILE_SHARE, MIN_WORDS = 0.6, 0.5, 3
FILE_NAME = r"(?i)^(un)?licen[sc]e|^copying|^notice|^mit-licen[sc]e"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(257, bool)
_STOP[[ord(c) for c in ".;!?"]] = True
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str) -> list[bytes]:
    """Runs of letters and digits in lower case (A-Z)."""
    return _TOKEN.findall(bt.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())


class Templates:
    """Templates as unit TF-IDF vectors over their words."""

    def __init__(self, templates: dict[str, list[str]], weak: frozenset[str] = WEAK):
        flat = [(name, Counter(tokens(t))) for name in sorted(templates) for t in templates[name]]
        df = Counter(w for _, c in flat for w in c)
        self.idf = {w: log((1 + len(flat)) / n) for w, n in df.items()}
        self.rare = log(1 + len(flat))
        self.names = sorted(templates)
        self.of = np.array([self.names.index(n) for n, _ in flat])
        self.weak = np.array([n in weak for n, _ in flat])
        words = sorted(df)
        data = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends, _ = bt.words(data, np.array([0, len(data)]), _LETTER[data])
        h = bt.span_hashes(bt.prefix_sums(data), starts, ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hash, self.weight = h[order], np.array([self.idf[w] for w in words])[order]
        at = {words[k]: i for i, k in enumerate(order.tolist())}
        self.vectors = np.zeros((len(flat), len(words)))
        for v, (_, c) in zip(self.vectors, flat, strict=True):
            for w, n in c.items():
                v[at[w]] = n * self.idf[w]
            v /= np.sqrt((v * v).sum())

    def pieces(self, h: np.ndarray, known: np.ndarray, piece: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, template, cosine) of pieces that reach `least`; h, known and piece of each word, pieces rising from 0."""
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        _, rep, n = np.unique(bt.mix(h + bt.mix(piece.astype(np.uint64))), return_index=True, return_counts=True)
        k, p = known[rep], piece[rep]
        w = n * np.where(k >= 0, self.weight[k], self.rare)
        count = int(piece[-1]) + 1
        size = np.bincount(p, w * w, count)
        own = np.bincount(p[k >= 0], (w * w)[k >= 0], count)
        few = np.bincount(piece[known >= 0], minlength=count)
        # Cosine is at most the known part's share of the length.
        hope = np.flatnonzero((own >= least * least * size * (1 - 1e-12)) & (few >= MIN_WORDS))
        slot = np.full(count, -1)
        slot[hope] = np.arange(len(hope))
        use = np.flatnonzero((k >= 0) & (slot[p] >= 0))
        use = use[np.argsort(slot[p[use]], kind="stable")]
        at, col, val = slot[p[use]], k[use], w[use]
        out = []
        for a in range(0, len(hope), 1024):
            s = slice(*np.searchsorted(at, [a, a + 1024]))
            dense = np.zeros((min(1024, len(hope) - a), len(self.weight)))
            dense[at[s] - a, col[s]] = val[s]
            cosine = np.minimum(1.0, dense @ self.vectors.T / np.sqrt(size[hope[a : a + 1024]])[:, None])
            i, t = np.nonzero(cosine >= least)
            out.append((hope[a + i], t, cosine[i, t]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def scan(self, data: np.ndarray, off: np.ndarray, least: float) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Licence, its cosine and the share of words in pieces that are like a template, of each text."""
        data = bt.LOWER[data]
        starts, ends, first = bt.words(data, off, _LETTER[data])
        n = len(off) - 1
        h = bt.span_hashes(bt.prefix_sums(data), starts, ends)
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        known = np.where(self.hash[at] == h, at, -1) if len(self.hash) else np.full(len(h), -1)
        doc = np.repeat(np.arange(n), np.diff(first))
        new_doc = np.diff(doc, prepend=-1) != 0
        lines = np.diff(np.searchsorted(np.flatnonzero(data == 10), starts), prepend=0)
        after = np.append(data, 0).astype(np.int64)[ends] if len(ends) else ends
        stop = np.zeros(len(h), bool)
        stop[1:] = _STOP[after[:-1]] & (np.append(data, 32)[np.minimum(ends[:-1] + 1, len(data))] <= 32)
        covered = np.zeros(len(h), bool)
        found = []
        for cut in (new_doc, new_doc | (lines > 1), new_doc | (lines > 0), new_doc | (lines > 0) | stop):
            piece = np.cumsum(cut) - 1
            p, t, x = self.pieces(h, known, piece, least)
            head = np.flatnonzero(cut)
            like = np.zeros(len(head), bool)
            like[p] = True
            covered |= like[piece] if len(h) else covered
            found.append((doc[head[p]], t, x))
        d, t, x = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((t, -np.round(x, 12), self.weak[t], d))
        d, t, x = d[order], t[order], x[order]
        head = np.flatnonzero(np.diff(d, prepend=-1))
        names: list[str | None] = [None] * n
        score = np.zeros(n)
        for i in head.tolist():
            names[d[i]], score[d[i]] = self.names[self.of[t[i]]], x[i]
        share = np.bincount(doc[covered], minlength=n) / np.maximum(np.diff(first), 1)
        return names, score, share


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST, keep_text: bool = True) -> DataFrame:
    """files with license, license_score, license_from and license_is_file in place of columns of those names.

    license_score is the cosine of the most similar piece, 0 where none reaches `least`. Equally similar
    templates: the first licence by name; a licence of WEAK only where no other is found. license_from is
    the file's own path, or that of the directory it inherits from ('' for the root), or null. A null or
    empty text has no licence of its own. A null path neither gives nor inherits. If a directory has
    several licence files, those named so come first, then the highest score, then the first licence by
    name. Repeated rows give a row each; an empty table an empty result. Without keep_text, text_col is
    left out, and the texts are read once instead of twice.
    """
    extra = ["license", "license_score", "license_from", "license_is_file"]
    names = [c for c in files.columns if c not in extra]
    known = Templates(templates or TEMPLATES)
    files = files.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bt.small(batches):
            found: list[tuple] = []
            for _, data, off in bt.chunks(b.column(at), b.column(at)):
                found += zip(*known.scan(data, off, least), strict=True)
            cols = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], [*names, "license", "license_score", "__share"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    found = files.mapInArrow(run, f"{kinds}, license string, license_score double, __share double")
    if not keep_text:
        names = [c for c in names if c != text_col]
        found = scratch.save(found.drop(text_col), "licences")
    found = found.withColumn("__dir", F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1))
    named = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1).rlike(FILE_NAME)
    found = found.withColumn("__named", F.coalesce(named, F.lit(False)))
    found = found.withColumn("license_is_file", F.col("license").isNotNull() & (F.col("__named") | (F.col("__share") >= FILE_SHARE)))
    best = F.min(F.struct((~F.col("__named")).alias("n"), (-F.col("license_score")).alias("s"), F.col("license").alias("l")))
    speaks = found.where("license_is_file and __dir is not null").groupBy(F.col("__dir").alias("__up")).agg(best.alias("x"))
    speaks = speaks.select("__up", F.col("x.l").alias("__license"))
    # Ancestors of the distinct directories, not of the files; the root is the empty one.
    steps = F.split("__dir", "/")
    paths = found if not keep_text else files.withColumn("__dir", F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1))
    dirs = paths.select("__dir").where("__dir is not null").distinct().select("__dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("__depth"))
    dirs = dirs.withColumn("__up", F.array_join(F.slice(steps, F.lit(1), F.col("__depth")), "/"))
    near = dirs.join(speaks, "__up").groupBy("__dir").agg(F.max(F.struct("__depth", "__up", "__license")).alias("__near"))
    out = found.join(near, "__dir", "left")
    own = F.col("license").isNotNull()
    return out.select(*names, F.coalesce("license", "__near.__license").alias("license"), "license_score", F.when(own, F.col(path_col)).otherwise(F.col("__near.__up")).alias("license_from"), "license_is_file")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a tree, and runs of 4096 and of 64 ids are its directories."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", F.concat(F.lit("d"), F.expr("doc_id div 4096")), F.concat(F.lit("e"), F.expr("doc_id div 64")), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), keep_text=False)
