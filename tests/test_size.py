"""Steps that have to move and hold little: their plans, and the same results as the slower way."""

import random

import numpy as np
import pytest

from memloom import agent_queries, queries
from memloom.config import Expansion
from memloom.operators import ingest, passages, vectors

assert agent_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["line", "section", "sentence", "paragraph"])
def test_expansion_moves_no_tokens(spark, name):
    text = plan(queries.QUERIES[f"passage_expand_{name}"](spark, SF))
    assert "Join" not in text and "Aggregate" not in text and "Window" not in text


@pytest.mark.parametrize("least,most,stops", [(0, 5, [["."], ["!"]]), (2, 9, [[".", "."], ["!"], ["!", "."]]), (0, 40, [[".", "!", "."]]), (3, 3, [["."]]), (0, 7, [])])
def test_expand_all(spark, least, most, stops):
    """Texts of many lengths in sections of many texts, some empty: what expand() gives for each chunk."""
    r = random.Random(5)
    rows = [(m, i, i // 7, "".join(r.choice(".!?:;") for _ in range(r.choice([0, 1, 2, 3, 9, 40])))) for m in range(3) for i in range(30)]
    placed = ingest.place(spark.createDataFrame(rows, "mem_id long, ord long, section_id long, text string"))
    k = ingest.retain(ingest.number(ingest.chunks(placed, 6, 4)), 1 << 40)
    k = k.withColumn("first_seq", k.section_from)
    cols = ["mem_id", "section_id", "chunk_no", "p_from", "p_to"]
    e = Expansion(least, most)
    want = passages.expand(k.drop("tokens", "text_keys"), k, e, 4, stops).select(cols)
    got = passages.expand_all(placed, e, 6, 4, stops).select(cols)
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["retrieve_topk", "retrieve_matched", "acc_at_k"])
def test_search_stores_no_vectors(spark, name):
    """Only hits and the chunks of their memories are stored, not the corpus and its vectors."""
    stored = [x for x in plan(queries.QUERIES[name](spark, SF)).splitlines() if "InMemoryRelation" in x]
    assert stored and not any("embedding" in x for x in stored)


def test_nearest(spark):
    """Ids that repeat in and across batches, ties, and vectors that are not numbers: what brute force finds."""
    r = np.random.default_rng(3)
    ids, v = r.integers(0, 90, 400), r.integers(-2, 3, (400, 6)) * 100.0
    v[r.random(400) < 0.7, 2] = np.nan
    q = np.concatenate([r.integers(-2, 3, (9, 6)) * 100.0, v[~np.isnan(v).any(1)][:3]])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        store = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, embedding array<double>").repartition(3)
        asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
        got = {(x.query_id, x["rank"]): (x.id, x.distance) for x in vectors.nearest(store, asked, 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i, x in enumerate(q):
        near = {}
        for j, d in zip(ids, ((v - x) ** 2).sum(1), strict=True):
            if not np.isnan(d):
                near[int(j)] = min(d, near.get(int(j), np.inf))
        want |= {(i, n + 1): y for n, y in enumerate(sorted(near.items(), key=lambda y: (y[1], y[0]))[:7])}
    assert got == want


def test_retention_holds_no_memory(spark):
    """Chunks of documents number themselves: nothing is joined, grouped or sorted."""
    text = plan(queries.QUERIES["chunk_retention"](spark, SF))
    assert "Join" not in text and "Aggregate" not in text and "Window" not in text


def test_numbers_alone(spark):
    """Memories of one text: bounds, numbers and what is left are those of the general way."""
    texts = spark.createDataFrame([(m, 0, "." * n) for m, n in enumerate([0, 1, 3, 4, 5, 8, 30, 31])] + [(None, 0, None), (99, 0, None)], "mem_id long, ord long, text string")
    want = ingest.retain(ingest.number(ingest.chunks(ingest.place(texts), 6, 4)), 3)
    alone = ingest.place(texts, alone=True)
    cols = ["mem_id", "chunk_no", "from_seq", "to_seq", "chunk_id", "mem_chunks", "first_seq"]
    got = ingest.retain(ingest.number(ingest.bounds(alone, 6, 4), 4), 3, 4)
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    cols = ["mem_id", "chunk_no", "from_seq", "to_seq", "text", "text_keys"]
    assert sorted(ingest.chunks(alone, 6, 4, alone=True).select(cols).collect()) == sorted(ingest.chunks(ingest.place(texts), 6, 4).select(cols).collect())


def test_dirty_chunks_joins_bounds_alone(spark):
    """Chunks to embed are told from bounds: one join of keys, and nothing else holds rows."""
    text = plan(queries.QUERIES["dirty_chunks"](spark, SF))
    assert text.count("Join") == 1 and "Aggregate" not in text and "Window" not in text
