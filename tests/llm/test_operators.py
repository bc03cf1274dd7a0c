"""Operators on small fixtures with nulls, empty, repeated and odd rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memloom.llm import components, embedding_dedup, katz, langid, licenses, minhash, mixing, packing, quality, suffix_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORD = re.compile("[^\x20\x09-\x0d]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n, words="the of and house river tree walks under stone light green"):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words.split(), n)) + f" end{seed}."


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    near = base.replace("end1.", "other.")
    texts = [base, base, near, None, "", "   \n\t", "Ünïcode ☃ 😀 <|endoftext|> x", prose(2, 3), "a" * 5000, prose(3, 2000), prose(4, 60) + " " + base[:300], "word " * 80]
    rows = [(i, t, ["en", None][i % 7 == 3], None if i == 5 else f"s{i % 3}", len(t or ""), 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_empty_tables(spark):
    e = spark.createDataFrame([], DOCS)
    assert token_counts.count_tokens(e, BPE).count() == 0
    assert packing.pack(e, BPE).count() == 0
    assert langid.identify(e, langid.fit(e)).count() == 0
    assert quality.apply_rules(e, quality.fit(e)).count() == 0
    assert minhash.near_groups(e).count() == 0
    assert suffix_dedup.remove_repeats(e).count() == 0
    assert mixing.mix(e).count() == 0
    assert licenses.scan(e.withColumn("path", F.lit("a/b"))).count() == 0
    assert katz.katz_scores(e, F.lit(True)).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_token_counts(docs):
    tok = token_counts.tokenizer(BPE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BPE).collect()}
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 1024)


def test_packing(docs):
    tok = token_counts.tokenizer(BPE)
    pieces = packing.pack(docs, BPE).collect()
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    at = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == at.get(p.doc_id, 0) and len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        at[p.doc_id] = p.start + p.length
    assert at == {k: len(v) for k, v in ids.items()}
    size = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == size.get(p.sequence_id, 0)
        size[p.sequence_id] = p.offset + p.length
    assert all(v == 1024 for k, v in size.items() if k < max(size))


def test_hilbert():
    x = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    key = packing.hilbert(x, 2)
    assert sorted(key) == list(range(64))
    assert (np.abs(np.diff(x[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_language(spark):
    en, de = "the house and the river of the valley that was there with them", "der die das und ein haus mit dem fluss ist nicht auf den"
    rows = [(i, " ".join(np.random.default_rng(i).choice((en if i % 2 else de).split(), 30)), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame([*rows, (90, None, "en"), (91, "123 !!", None), (92, en * 500, None), (92, en * 500, None)], "doc_id long, text string, lang string")
    got = langid.identify(df.withColumn("lang_pred", F.lit(7)), langid.fit(df.where("doc_id < 30"))).collect()
    assert len(got) == 44
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id < 40)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (90, 91)} == {90: ("und", 0.0), 91: ("und", 0.0)}
    assert [r.lang_pred for r in got if r.doc_id == 92] == ["en", "en"]


def test_quality(docs):
    got = {r.doc_id: r for r in quality.apply_rules(docs, quality.fit(docs)).collect()}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(hit))
        assert g.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (g.base_failed and g.kept)
    assert not got[11].kept and quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_near_copies(docs):
    got = {r.doc_id: r for r in minhash.near_groups(docs).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(low))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (len(s), root[i], root[i] == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_large_node(spark):
    """Near copies beyond a node's size still form one group."""
    base = prose(5, 300).split()
    rows = [(i, " ".join([*base[: i % 290], f"new{i}", *base[i % 290 :]])) for i in range(700)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in range(0, 120):
        x = rng.integers(0, rng.choice([1, 2, 4, 200]), n)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_passages(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [(g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in (got[r.doc_id] for r in rows)] == removed([r.text for r in rows])
    assert got[3].kept_text is None and got[1].kept_text == "" and got[0].kept_text == rows[0].text


def test_passages_odd_ids(spark):
    t = prose(8, 60)
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, t), (2, "é" * 200)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed > 0 for r in got) == [False, True, True, True]
    assert [r.kept_text for r in got if r.doc_id == 2][0].strip("é") == ""


def test_katz(spark):
    text = ["the cat sat on the mat", "the cat sat", "The dog sat on the log", None, "a b c a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text * 4)], "doc_id long, text string").withColumn("score", F.lit("x"))
    held = {3, 4, 12}
    got = {r.doc_id: r for r in katz.katz_scores(df, ~F.col("doc_id").isin(*held)).collect()}
    c = Counter(w for i, t in enumerate(text * 4) if i not in held for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(text * 4):
        w = [*(t or "").lower().split(), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in c for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i].score < 0


def test_mixing(spark):
    rows = [(i, "big" if i < 800 else "mid" if i < 950 else None, int(1 + i % 7)) for i in range(1000)]
    df = spark.createDataFrame([*rows, (5000, "none", 0)], "doc_id long, source string, n long").withColumn("mix_epoch", F.lit("x"))
    out = mixing.mix(df, entropy=0.99, max_repeat=3.0, tokens_col="n", block_tokens=200).collect()
    seen = Counter(r.doc_id for r in out)
    assert set(seen) == {r[0] for r in rows} | {5000} and max(seen.values()) <= 3
    t, got = Counter(), Counter()
    for _, s, n in rows:
        t[s] += n
    for r in out:
        got[r.source] += r.mix_tokens
    alpha = out[0].mix_alpha
    assert (t["big"] / t[None]) ** (1 - alpha) == pytest.approx(3.0, rel=1e-3)
    for s in t:
        want = t[s] * (t["big"] / t[s]) ** (1 - alpha)
        assert want - 1 <= got[s] <= want + 8
    short = Counter(r.source for r in mixing.mix(df, total_tokens=400, tokens_col="n", block_tokens=50).collect())
    assert 0 < sum(short.values()) < 200


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 8))
    x[1:700] = x[0] + 0.03 * rng.standard_normal((699, 8))
    rows = [(i, v.tolist(), 0 if i < 1400 else i % 2) for i, v in enumerate(x)]
    odd = [(2000, [0.0] * 8, 0), (2001, None, 0), (2002, [float("nan")] * 8, 0), (2003, x[0].tolist(), None), (2004, [1.0, None], 0), (2005, (x[0] * 5).tolist(), 0), (None, x[0].tolist(), 0), (2006, [1.0], 0), (2005, (x[0] * 5).tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(0))
    got = embedding_dedup.near_vectors(df, block=256).collect()
    good = [(i, np.array(v), lab) for i, v, lab in [*rows, odd[5], odd[8]]]
    m = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    lab = np.array([k for *_, k in good])
    near = (m @ m.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    comp = np.array([i for i, *_ in good])
    while True:
        new = np.array([min(c, comp[r].min(initial=1 << 60)) for c, r in zip(comp, near, strict=True)])
        if (new == comp).all():
            break
        comp = new
    want = sorted((i, int(k), int(c)) for (i, *_), k, c in zip(good, near.sum(1), comp, strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and (r.vec_id < 2000 or r.vec_id == 2005)) == want
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id in (2000, 2001, 2002, 2003, 2004, 2006))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (None, 3)], "u long, v long").repartition(7)
    got = {r.id: r.component_id for r in components.components(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs, columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), None
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        columns = columns or docs.columns
        assert docs.columns == columns and docs.count() > 100
    assert p.STAGES[-1][1](spark, docs, "").count() > 100


def test_pipeline_near_copies(spark):
    """The stage leaves one of two documents that share between 80 and 85 % of their shingles."""
    import corpus_pipeline as p

    a = [f"w{i}" for i in range(204)]
    b = [f"x{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(a)]
    s, t = ({tuple(x[i : i + 5]) for i in range(200)} for x in (a, b))
    assert 0.8 <= len(s & t) / len(s | t) < 0.85
    rows = [(i, " ".join(x), "en", "s", 1) for i, x in enumerate((a, b))]
    got = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert [r.doc_id for r in got.collect()] == [0]


def test_near_copies_in_large_nodes(spark, monkeypatch):
    """Pairs above the threshold are found where a shared passage makes the nodes large at every depth."""
    monkeypatch.setattr(minhash, "NODE", 16)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    shared, rows, sets = [f"s{i}" for i in range(200)], [], []
    for i in range(300):
        own = [f"a{i}x{k}" for k in range(40)]
        other = [f"b{i}" if k in (8, 16, 24, 38, 39) else w for k, w in enumerate(own)]
        for x in (own, other):
            x = [*shared, *x]
            rows.append((len(rows), " ".join(x)))
            sets.append({tuple(x[j : j + 5]) for j in range(len(x) - 4)})
    assert all(100 * len(s & t) >= 85 * len(s | t) for s, t in zip(sets[::2], sets[1::2]))
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(0, 600, 2))
    assert sum(got[i] != i - 1 for i in range(1, 600, 2)) <= 2


def test_blocks_across_components(spark):
    """Every pair of different components of a node meets; a node of one component has nothing to do."""
    of = lambda i: 0 if i < 400 else 400 if i < 450 else i
    member = spark.createDataFrame([(7, i, of(i)) for i in range(700)] + [(8, i, 0) for i in range(300)], "node long, rep long, comp long")
    met = {}
    for r in minhash._across(member).collect():
        met.setdefault(r.key, []).append(r.rep)
    pairs = {(a, b) for x in met.values() for a in x for b in x if a < b}
    assert all((a, b) in pairs for b in range(700) for a in range(b) if of(a) != of(b))
    assert max(map(len, met.values())) < 2 * minhash.NODE


def test_suffix_array_long():
    """Keys of the merge stay within 64 bits."""
    x = np.random.default_rng(3).permutation(2_600_000)
    assert (suffix_dedup.suffix_array(x) == np.argsort(x)).all()


def test_split_anchor(monkeypatch):
    """An anchor's runs, split by further keys, give the same repeats."""
    rng = np.random.default_rng(4)
    line = bytes(rng.integers(97, 123, 71, dtype=np.uint8))
    sides = [bytes(rng.integers(97, 123, 48, dtype=np.uint8)) for _ in range(40)]
    texts = [sides[rng.integers(40)] + line + sides[rng.integers(40)] for _ in range(200)]
    n = np.arange(200)

    def mask():
        out = np.zeros((200, 167), bool)
        for d, a, z in suffix_dedup.compare_runs(np.full(200, 5, np.uint64), n, n * 0, texts):
            out[d, a:z] = True
        return out

    want = mask()
    monkeypatch.setattr(suffix_dedup, "SPLIT", 2000)
    assert want.any() and not want.all() and (mask() == want).all()
