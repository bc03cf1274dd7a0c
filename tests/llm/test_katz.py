"""Katz scores against a model of plain dictionaries, whose distributions are summed."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import katz

UNK = "unknown word"


class Plain:
    """Katz backoff of any order, one probability at a time."""

    def __init__(self, texts, order):
        self.order = order
        self.c = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = ["<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    self.c[k][tuple(w[i - k + 1 : i + 1])] += 1
        self.n = sum(self.c[1].values())
        self.d = [None] + [katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.GT_MAX + 2)]) for c in self.c[1:]]
        self.next = Counter()
        self.after = {}
        for k in range(2, order + 1):
            for g, v in self.c[k].items():
                self.after.setdefault(g[:-1], {})[g[-1]] = v
        freed = self.n - sum(self.mass(1, v) for v in self.c[1].values())
        self.unknown = freed / self.n if freed else 1 / (self.n + 1)
        self.scale = 1 if freed else self.n / (self.n + 1)

    def mass(self, k, c):
        return self.d[k][min(c, katz.GT_MAX + 1)] * c

    def p(self, w, h):
        if not h:
            c = self.c[1][(w,)]
            return self.mass(1, c) / self.n * self.scale if c else self.unknown
        seen = self.after.get(h)
        if not seen:
            return self.p(w, h[1:])
        total, k = sum(seen.values()), len(h) + 1
        freed = sum(c - self.mass(k, c) for c in seen.values())
        keep = 1 if freed > 0 else total / (total + 1)
        if w in seen:
            return keep * self.mass(k, seen[w]) / total
        left = freed / total if freed > 0 else 1 / (total + 1)
        return left * self.p(w, h[1:]) / (1 - sum(self.p(x, h[1:]) for x in seen))

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(w[i], tuple(w[i - self.order + 1 : i]))) for i in range(self.order - 1, len(w)))


def tokens(t):
    return [*(t or "").lower().split(), "</s>"]


def corpus(seed, n, size=40):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    out = [" ".join(rng.choice(words, rng.integers(0, size), p=p / p.sum())) for _ in range(n)]
    return out + ["always the same line of words"] * 9 + [None, "", "Always THE same"]


@pytest.mark.parametrize(("order", "block"), [(2, 1 << 20), (3, 400), (4, 300)])
def test_katz_equals_plain_model(spark, order, block):
    texts = corpus(order, 80)
    held = {i for i in range(len(texts)) if i % 5 == 0} | {len(texts) - 1}
    model = Plain([t for i, t in enumerate(texts) if i not in held], order)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in katz.katz_scores(df, ~F.col("doc_id").isin(*held), order, block).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(model.score(t), rel=1e-9), i
        assert got[i].trained == (i not in held)
    # Every history's distribution sums to one, seen, unseen and at the start.
    vocabulary = [w for (w,) in model.c[1]] + [UNK]
    for h in [("<s>",) * (order - 1), ("w0",) * (order - 1), ("w1", "w0", "w2")[: order - 1], ("always", "the", "same")[: order - 1], ("nowhere",) * (order - 1)]:
        assert sum(model.p(w, h) for w in vocabulary) == pytest.approx(1)


def test_katz_operator_sums_to_one(spark):
    """The operator's own next-word distribution: every known word, the end and one unknown word after a fixed start."""
    texts = corpus(9, 60)
    known = sorted({w for t in texts for w in tokens(t)[:-1]})
    for start in ("w0 w1", "always the", "w3 never"):
        probes = [f"{start} {w}" for w in [*known, "neverseen"]] + [start]
        rows = [(i, t, i < len(texts)) for i, t in enumerate([*texts, *probes])]
        df = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
        # P(start w end) / P(end | start w) needs the ends: score each probe with and without its last token by a longer probe.
        got = {r.doc_id: r.score for r in katz.katz_scores(df, F.col("t")).collect()}
        plain = Plain(texts, katz.ORDER)
        h = tuple(start.split())
        prefix = plain.score(start) - math.log10(plain.p("</s>", h))
        mass = 10 ** (got[len(rows) - 1] - prefix)
        for k, w in enumerate([*known, "neverseen"]):
            mass += 10 ** (got[len(texts) + k] - prefix - math.log10(plain.p("</s>", (h[-1], w))))
        assert mass == pytest.approx(1)


def test_katz_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a c"), (2, None)], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("trained", F.lit(3))
    got = katz.katz_scores(df, F.col("doc_id") > 1).collect()
    assert sorted((r.doc_id or 0, r.trained, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, False, 3, 1, 1), (1, False, 3, 1, 1), (1, False, 3, 1, 1), (2, True, 1, 1, 1)]
    none = katz.katz_scores(df, F.lit(None).cast("boolean")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
    with pytest.raises(ValueError):
        katz.katz_scores(df, F.lit(True), order=1)
