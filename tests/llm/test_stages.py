"""The pipeline's stages on nulls, empty tables, repeated rows, ties and extra columns, and the queries of the folder."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from memloom.llm import minhash, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(tag, n):
    return " ".join(f"{tag}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    a, b = words("a", 150), words("b", 150)
    rows = [(1, a, "en", "s", 5), (2, a, "en", "s", 5), (2, a, "en", "s", 5), (None, a, "en", None, None), (None, b, None, "t", 1), (3, b + " more", "en", "t", 1), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "12 !", "en", "s", 1), (7, words("c", 500) * 20, "en", "s", 9)]
    return spark.createDataFrame([(*r, "x") for r in rows], KIND + ", mix_epoch string").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_empty(spark):
    e = spark.createDataFrame([], KIND)
    for _, stage in p.STAGES:
        assert stage(spark, e, "").count() == 0


def test_language_stage(spark, odd):
    got = p.identify_language(spark, odd, "")
    assert got.columns == list(p.COLUMNS)
    kept = rows(got)
    assert sorted(str(r[0]) for r in kept) == sorted(["1", "2", "2", "None", "None", "3", "7"])
    assert all(r[2] == "en" for r in kept)


def test_near_stage(spark, odd):
    got = rows(p.drop_near_copies(spark, odd, ""))
    assert sorted(str(r[0]) for r in got) == ["1", "3", "4", "5", "6", "7"]
    unique = odd.where("doc_id in (1, 3, 5, 7)")
    assert rows(p.drop_near_copies(spark, unique, "")) == rows(unique.select(*p.COLUMNS))


def test_suffix_stage(spark, odd):
    got = rows(p.remove_repeated_passages(spark, odd, ""))
    texts = {str(r[0]): r[1] for r in got}
    assert texts["1"] == words("a", 150) and texts["4"] is None and texts["5"] == "" and "2" not in texts
    assert texts["3"].startswith("ba") and all(r[4] == len(r[1]) for r in got if str(r[0]) == "7")


def test_mixing_stage(spark, odd):
    got = rows(p.mix_sources(spark, odd, ""))
    assert {r[0] for r in got} == {r.doc_id for r in odd.collect()}
    assert max(got.count(r) for r in got) <= 4


def test_packing_stage(spark, odd):
    got = p.pack_sequences(spark, odd, "").collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n == 1024 for k, n in sizes.items() if k < max(sizes))
    assert sorted(str(r.doc_id) for r in got if r.start == 0) == sorted(str(r.doc_id) for r in odd.collect())


def test_repeated_ids_do_not_depend_on_order(spark):
    """Two texts of one id link with the copies of both, in any order of rows."""
    a, b = words("a", 200), words("b", 200)
    data = [(1, a), (1, b), (2, a + " x"), (3, b + " y")]
    for order in ([0, 1, 2, 3], [1, 0, 3, 2], [3, 1, 2, 0]):
        got = minhash.near_groups(spark.createDataFrame([data[i] for i in order], "doc_id long, text string").coalesce(1))
        assert {r.component_id for r in got.collect()} == {1}


@pytest.mark.parametrize("depth", minhash.DEPTHS)
def test_recall_by_depth(depth):
    """At least nine in ten pairs at the threshold share a node at every depth."""
    import numpy as np

    from memloom.llm import bytetext as bt

    for share in (0.8, 0.85):
        trees = minhash.tree_counts(share)[minhash.DEPTHS.index(depth)]
        rng, met, n = np.random.default_rng(depth), 0, 150
        for _ in range(n):
            m = 400
            both = round(2 * m * share / (1 + share))
            u = rng.integers(1, 1 << 63, 2 * m - both, dtype=np.uint64)
            sk = np.stack([minhash.sketch(bt.mix(u[:m])), minhash.sketch(bt.mix(u[m - both :]))])
            met += any(len(set(minhash.paths(sk, t, (depth,))[0].tolist())) == 1 for t in range(trees))
        assert met >= 0.97 * n


def test_queries(spark):
    """Every query of the folder returns a row for each row of its table, or the pieces and the mix of all."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for name, f in queries.QUERIES.items():
        out = f(spark, sf)
        n = out.count()
        if name.startswith("op5"):
            assert n == vectors
        elif name.startswith(("op4", "op10")):
            assert out.select("doc_id").distinct().count() == docs
        elif name.startswith("op"):
            assert n == docs, name
    held = queries.QUERIES["op1_language_id"](spark, sf).where("held_out").select("doc_id").collect()
    import zlib

    assert sorted(r.doc_id for r in held) == [i for i in range(docs) if zlib.crc32(str(i).encode()) % 4 == 2]


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").agg(F.count("doc_id")).first()[0] > 100
