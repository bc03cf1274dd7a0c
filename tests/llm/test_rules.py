"""Licences, quality and language against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import langid, licenses, quality
from memloom.llm.license_texts import _MIT, _NOTICE, _WARRANTY, TEMPLATES, WEAK


def plain_cosines(text, known):
    """(weak, -cosine, template, words) of each piece of a text that is like a template, one dictionary at a time."""
    flat = [(name, Counter(licenses.tokens(t))) for name in sorted(TEMPLATES) for t in TEMPLATES[name]]
    df = Counter(w for _, c in flat for w in c)
    idf = lambda w: math.log((1 + len(flat)) / df[w]) if w in df else math.log(1 + len(flat))
    unit = lambda c: {w: n * idf(w) for w, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    pieces = [text, *re.split(r"\n[^0-9A-Za-z\x80-\uffff]*\n", text), *text.split("\n")]
    pieces += [s for line in text.split("\n") for s in re.split(r"(?<=[0-9A-Za-z\x80-\uffff][.;!?])(?=\s)", line)]
    out = []
    for p in pieces:
        c = Counter(licenses.tokens(p))
        if sum(n for w, n in c.items() if w in df) >= licenses.MIN_WORDS:
            v = unit(c)
            for name, t in flat:
                u = unit(t)
                x = sum(v[w] * u[w] for w in v if w in u) / size(v) / size(u)
                if x >= licenses.LEAST:
                    out.append((name in WEAK, -round(x, 12), name))
    return min(out, default=None)


def test_licences(spark):
    mit = f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{_MIT}\n\n{_NOTICE}\n\n{_WARRANTY}\n"
    wrapped = re.sub(r"(.{60,75}) ", r"\1\n", mit)
    rows = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("src/a/b/x", "no notice here"), ("src/a/COPYING", wrapped), ("src/y", "text " * 50 + "\nLicensed under CC BY-NC 4.0.\n"), ("src/z", "nothing"), (None, "All rights reserved."), ("src/a/b/x", None), ("src/e", ""), ("/abs/f", "of the and in"), ("src/long", "lorem ipsum. " * 3000 + "Released under the MIT License. " + "dolor " * 900), ("t/tie", "All rights reserved. Licensed under the ISC License."), ("k/LICENSE", "Copyright me. All rights reserved."), ("k/c.py", "# Copyright 2020 Someone\n# SPDX-License-Identifier: BSD-3-Clause\n\nimport os\n")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit(1)).withColumn("license_from", F.lit("x"))
    got = sorted(((r.path or "", r.license, r.license_from) for r in licenses.scan(df).collect()), key=str)
    want = [("LICENSE", "Apache-2.0", "LICENSE"), ("src/a/b/x", "MIT", "src/a"), ("src/a/COPYING", "MIT", "src/a/COPYING"), ("src/y", "CC-BY-NC-4.0", "src/y"), ("src/z", "Apache-2.0", ""), ("", "Proprietary", None), ("src/a/b/x", "MIT", "src/a"), ("src/e", "Apache-2.0", ""), ("/abs/f", "Apache-2.0", ""), ("src/long", "MIT", "src/long"), ("t/tie", "ISC", "t/tie"), ("k/LICENSE", "Proprietary", "k/LICENSE"), ("k/c.py", "BSD-3-Clause", "k/c.py")]
    assert got == sorted(want, key=str)
    known = licenses.Templates(TEMPLATES)
    own = {r.path: r for r in licenses.scan(df).collect() if r.path != "src/a/b/x"}
    for path, text in rows:
        if path and path != "src/a/b/x":
            best = plain_cosines(text or "", known)
            assert own[path].license_score == pytest.approx(-best[1] if best else 0.0, abs=1e-9), path
            assert not best or own[path].license == best[2]
    assert licenses.scan(df.where("false")).count() == 0


def test_quality_verdicts(spark):
    """kept, from distances and medians worked out one document at a time."""
    rng = np.random.default_rng(5)
    words = {"en": "the of and house river tree walks under stone light".split(), "de": "der die und haus fluss baum geht unter stein licht".split()}
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang], rng.integers(12, 400))) + ".", lang))
    rows += [(500 + k, " ".join(f"<{k}#{j}|>" for j in range(200)), "en") for k in range(6)] + [(600, None, "en"), (601, "", None), (602, "the house " * 3, "en"), (0, rows[0][1], None)]
    rows += [(700, "x" * 20_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("x"))
    refs = quality.fit(df)
    counts = {lang: Counter(w for _, t, k in rows if k == lang and t for w in quality._tokens(t)) for lang in refs}
    for lang, ref in refs.items():
        top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
        assert ref["words"] == sorted(w for w, _ in top) and sum(ref["common"]) == sum(counts[lang].values())
    got = quality.apply_rules(df, refs, peers=30).collect()
    assert len(got) == len(rows)

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt((kl(p, q) + kl(q, p)) / 2)

    seen = {}
    for i, t, _ in rows:
        n = len((t or "").split())
        if not n:
            continue
        tok = Counter(quality._tokens(t))
        best = None
        for lang in sorted(refs):
            r = refs[lang]
            hits = [tok[w] for w in r["words"]]
            x, y = js(quality.class_counts(np.frombuffer(t.encode(), np.uint8)), r["classes"]), js([*hits, sum(tok.values()) - sum(hits)], r["common"]) if tok else 1.0
            if best is None or x + y < best[0] + best[1] - 1e-12:
                best = (x, y, lang)
        seen[i] = (n, *best)
    by_id = {r.doc_id: r for r in got if r.n_words}
    for i, (_, x, y, lang) in seen.items():
        assert (by_id[i].class_distance, by_id[i].common_distance) == (pytest.approx(x), pytest.approx(y)) and by_id[i].nearest == lang
    med = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    passed = [r for r in got if not r.base_failed]
    for r in got:
        if r.base_failed:
            assert not r.kept
            continue
        ok = True
        for d, least in (("class_distance", 10), ("common_distance", 80)):
            peers = [p for p in passed if p.nearest == r.nearest and p.n_words.bit_length() == r.n_words.bit_length()]
            peers = peers if len(peers) >= 30 else [p for p in passed if p.nearest == r.nearest]
            peers = peers if len(peers) >= 30 else passed
            bins = [math.floor(p[d] * 1000) for p in peers]
            limit = med(bins) / 1000 + max(12 * med([abs(b - med(bins)) for b in bins]) / 1000, 0.1)
            ok &= not (r.n_words >= least and r[d] > limit)
        assert r.kept == ok, r
    assert not any(r.kept for r in got if 500 <= (r.doc_id or 0) < 600) and sum(r.kept for r in got) > 200
    assert {r.kept for r in quality.apply_rules(df.where("doc_id < 50"), {}).collect()} <= {True, False}
    assert quality.apply_rules(df.where("doc_id = 601"), refs).first().base_failed


def test_language_distance(spark):
    """Distance, ties, score and the fitted profiles, by dictionaries."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(list("abcdeé" if i % 2 else "bcdefß"), rng.integers(1, 6))) for _ in range(20)), "xx" if i % 2 else "yy") for i in range(30)]
    rows += [(100, "12 34", "xx"), (101, None, "yy"), (102, "abc", None), (103, "A1b", "zz"), (None, "abc abc", "xx"), (3, rows[3][1], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))

    def grams(t):
        t = re.sub(r"[^a-zA-Zéß]+", " ", f" {t.lower()} ")
        return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != " ") if t.strip() else Counter()

    def order(c, most):
        code = lambda g: sum(ord(x) << (21 * (len(g) - 1 - k)) for k, x in enumerate(g))
        return sorted(c, key=lambda g: (-c[g], code(g)))[:most]

    learned = {}
    for i, t, lang in rows:
        if t and lang and i is not None:
            learned.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: order(c, 400) for k, c in learned.items() if c}
    got = langid.identify(df, langid.fit(df)).collect()
    assert len(got) == len(rows) and set(df.columns) | {"lang_pred"} == set(got[0].asDict())
    want = {}
    for _, t, _ in rows:
        own = order(grams(t), 300) if t else []
        best = min(((sum(abs(p.index(g) - r) if g in p else 400 for r, g in enumerate(own)), lang) for lang, p in profiles.items()), default=None)
        want[t] = (best[1], 1 - min(1.0, best[0] / (400 * len(own)))) if own else ("und", 0.0)
    for r in got:
        assert (r.lang_pred, pytest.approx(r.score)) == want[r.text], r
    small = langid.fit(df, per_lang=4)
    assert small.langs == ["xx", "yy", "zz"]
