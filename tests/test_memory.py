"""Layout, expansion, overlaps, scores, JSON, store and stream against hand-made and published values."""

import pytest
from pyspark.sql import functions as F

from memloom.config import Expansion, Limit, MemoryConfig, check_layout
from memloom.functions import jsonfix
from memloom.functions import scores as S
from memloom.functions import text as T
from memloom.operators import ingest, passages
from memloom.plans import agent, evaluate, retrieve
from memloom.sources import readers, store
from memloom.streaming import append


def placed(spark, texts, seps=()):
    rows = [(1, i, t, i in seps) for i, t in enumerate(texts)]
    return ingest.place(spark.createDataFrame(rows, "mem_id long, ord long, text string, sep boolean"), separator="sep")


def layout(spark, texts, seps=(), c=5, s=2):
    out = ingest.number(ingest.chunks(placed(spark, texts, seps), c, s)).orderBy("chunk_id").collect()
    return ["".join(r.tokens) for r in out]


def test_layout(spark):
    # Marks are single tokens, so a character is a token.
    assert layout(spark, [".:;", "!?,", "()["]) == [".:;!?", ";!?,(", "?,()[", "()[", "["]
    assert layout(spark, [".:;", "!?,", "()["], {2}) == [".:;!?", ";!?,", "?,", "()[", "["]
    assert layout(spark, ["." * 8, "." * 8], c=24, s=12) == ["." * 16, "." * 4]
    assert layout(spark, [None, ""]) == []


def test_attributes(spark):
    t = spark.createDataFrame([(1, 0, "...", 1.0, "a", None), (1, 1, "...", 2.0, "b", 0.5), (1, 2, "...", 3.0, None, 0.1)], "mem_id long, ord long, text string, ts double, metadata string, importance double")
    rows = ingest.chunks(ingest.place(t), 5, 2).orderBy("chunk_no").collect()
    assert [r.text_keys for r in rows] == [[1, 2], [1, 2, 3], [2, 3], [3], [3]]
    assert [r.ts for r in rows] == [1, 1, 2, 3, 3]
    assert [r.metadata for r in rows] == ["a", "b", "b", None, None]
    assert [r.importance for r in rows] == [0.5, 0.5, 0.1, 0.1, 0.1]


@pytest.mark.parametrize("queue,c,s", [(2, 10, 6), (5, 0, 6), (5, 10, 4)])
def test_guards(queue, c, s):
    with pytest.raises(ValueError):
        check_layout(queue, c, s)


def test_settings():
    with pytest.raises(ValueError):
        Expansion(2048, 24, Limit.SECTION)
    with pytest.raises(ValueError):
        MemoryConfig(overlap=0.6)
    assert MemoryConfig(rerank_factor=7, capacity=8, expansion=Expansion.for_chunk()).sizes(3, True)[0] == 21


def test_replace_bounds(spark):
    b = spark.createDataFrame([(1, i * 2, min(i * 2 + 5, 9), 0) for i in range(5)], "mem_id long, from_seq long, to_seq long, stream_from long")
    e = spark.createDataFrame([(1, 3, 6, 7)], "mem_id long, from_seq long, old_to long, new_to long")
    got = sorted((r.from_seq, r.to_seq) for r in ingest.replace_bounds(b, e, 5, 2).collect())
    tokens = [1, 2, 3, 8, 9, 10, 9, 7, 8, 9]
    assert [tokens[a:z] for a, z in got] == [[1, 2, 3, 8, 9], [3, 8, 9, 10, 9], [9, 10, 9], [9], [7, 8, 9], [9]]


STREAM = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 10, 8, 12, 14, 11, 12, 3, 8, 21, 13, 12, 9, 3, 4, 28, 12, 8, 25]


@pytest.mark.parametrize(
    "stride,queue,want3,want5",
    [
        (2, 12, [7, 8, 9, 10, 11, 12, 10, 8], [9, 10, 11, 12, 10, 8, 12, 14, 11, 12, 3]),
        (5, 25, [12, 14, 11, 12, 3, 8, 21, 13, 12, 9, 3], [4, 28, 12, 8, 25]),
        (4, 25, [9, 10, 11, 12, 10, 8, 12, 14, 11, 12, 3], [21, 13, 12, 9, 3, 4, 28, 12, 8]),
    ],
)
def test_expansion(spark, stride, queue, want3, want5):
    t = spark.createDataFrame([(1, 0, STREAM)], "mem_id long, section_id long, tokens array<int>").withColumn("tokens", F.transform("tokens", lambda x: x.cast("string")))
    t = t.withColumn("text_key", F.lit(1)).withColumn("n_tokens", F.lit(30)).withColumn("from_seq", F.lit(0)).withColumn("to_seq", F.lit(30)).withColumn("section_from", F.lit(0)).withColumn("section_to", F.lit(30))
    k = ingest.retain(ingest.number(ingest.chunks(t, 5, stride)), queue)
    hits = k.where("chunk_id in (3, 5)").select("mem_id", "section_id", "chunk_id", "from_seq", "to_seq", "section_from", "section_to", "first_seq")
    got = {r.chunk_id: [int(x) for x in r.p_tokens] for r in passages.expand(hits, k, Expansion(0, 5), stride, [["3"], ["8"]]).collect()}
    assert got == {3: want3, 5: want5}


def test_greedy(spark):
    rows = [(1, 1, 0, 10), (1, 2, 2, 12), (1, 3, 20, 30), (1, 4, 0, 100), (1, 5, 50, 60)]
    df = spark.createDataFrame(rows, "query_id long, ord long, p_from long, p_to long")
    assert [r.ord for r in passages.greedy(df, 0.75, 9).orderBy("ord").collect()] == [1, 3, 4]
    assert [r.ord for r in passages.greedy(df, 0.75, 2).orderBy("ord").collect()] == [1, 3]
    assert [r.ord for r in passages.greedy(df, 0.75, 2, keep_overlaps=True).orderBy("ord").collect()] == [1, 2, 3]


def test_retrieve_and_rerank(spark):
    facts = ["The cat sleeps on the mat.", "Rain falls in spring.", "The dog chases the cat.", "Ships sail the sea."]
    t = spark.createDataFrame([(1, i, x, i, float(i)) for i, x in enumerate(facts)], "mem_id long, ord long, text string, section_id long, ts double")
    config = MemoryConfig(expansion=Expansion.for_section(most=24))
    k = retrieve.build(t, config).cache()
    q = spark.createDataFrame([(1, "sail the sea"), (2, ""), (3, None)], "query_id long, query string")
    got = {(r.query_id, r["rank"]): r.passage for r in retrieve.retrieve(k, q, 2, config).collect()}
    assert got[1, 1] == facts[3] and (2, 1) in got and (3, 2) in got
    late = retrieve.recency_rerank(100.0, 1.0, weights=(1e6, 0.0, 0.0))
    assert retrieve.retrieve(k, q, 1, config, rerank=late).where("query_id = 1").first().ts == 3.0
    only = retrieve.retrieve(k, q, 4, config, match=lambda d: d.withColumn("confidence", F.when(F.col("text").contains("Rain"), 0.9).otherwise(0.1)))
    assert only.where("query_id = 1 and rank = 1").first().passage == facts[1]


def test_texts(spark):
    t = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 1)], "mem_id long, text_key long, text string, ord long")
    keys = spark.createDataFrame([(1, 2), (1, 9)], "mem_id long, text_key long")
    assert {r.text_key: r.text for r in ingest.get_text(t, keys).collect()} == {2: "b", 9: None}
    assert [r.text for r in ingest.delete(t, keys).collect()] == ["a"]
    assert ingest.replace(t, keys.withColumn("text", F.lit("z"))).where("text_key = 2").first().text == "z"


JSON = [
    ('{"user": {"name": "x",}, "queries": ["a",], "summary": 1,}', ["user", "queries", "summary"]),
    ('Sure:\n```json\n{"x": "y"}\n```\nDone.', ["x"]),
    ('{"x": "y"} and more', ["x"]),
    ('Here {"x": "y"}', ["x"]),
    ('{"x": foo", "y": "bar"}', ["x", "y"]),
    ('{"x": ["foo" "bar"]}', ["x"]),
    ('{"a": 1 "b": 2}', ["a", "b"]),
    ('{"a": 1, // note\n "b": 2}', ["a", "b"]),
    ('{"a": [1, 2, ...], "b": 2, ...}', ["a", "b"]),
    ('{"a": , "b": 1}', ["a", "b"]),
    ('{"a": "one\ntwo"}', ["a"]),
    ('```javascript\n{"a": 1}\n```', ["a"]),
]


@pytest.mark.parametrize("raw,keys", JSON)
def test_json(raw, keys):
    assert list(jsonfix.parse(raw)) == keys


def test_json_column(spark):
    df = spark.createDataFrame([('{"a": 1,}',), (None,), ("no json",), ('{"b":2}',)], "s string")
    assert [r[0] for r in df.select(jsonfix.repaired(F.col("s"))).collect()] == ['{"a":1}', None, None, '{"b":2}']


def test_correctness(spark):
    rows = [("the cat sat on the mat.", "the cat sat on the mat"), ("I think the cat sat on a mat today", "the cat sat on the mat"), ("unrelated words only here now", "the cat sat on the mat"), ("x", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, e string").select(evaluate.correctness(F.col("p"), F.col("e"))).collect()]
    assert got[0] == 100 and 70 <= got[1] < 100 and got[2] <= 30 and got[3] == 0


def test_scalars(spark):
    r = spark.range(1).select(
        T.elapsed(F.lit(0.0), F.lit(900.0 * 1)).alias("a"), T.elapsed(F.lit(0.0), F.lit(0.5)).alias("b"), T.elapsed(F.lit(0.0), F.lit(86400 * 2.25)).alias("c"), T.text_to_html(F.lit("a<b\n\nc\nd")).alias("d"), T.scratchpad(F.lit("x```txt\nhi\n```")).alias("e"), S.importance_from_rating(F.lit("7")).alias("f"), S.importance_from_rating(F.lit("seven")).alias("g")
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("15 minute(s) ago", "just now", "2.2 day(s) ago", "a&lt;b<p>c<br>d")
    assert "hi" in r.e and abs(r.f - 6 / 9) < 1e-9 and r.g == 0


def test_history(spark):
    m = spark.createDataFrame([(1, i, "user", "word " * 5) for i in range(6)], "session_id long, turn long, role string, content string")
    assert [r.turn for r in agent.history(m, 25).orderBy("turn").collect()] == [4, 5]


def test_sources(spark):
    rows = spark.createDataFrame([(1, ["a", "bbb", "ccc"], [0, 1], ["p", "q"])], "query_id long, answers array<string>, is_selected array<int>, passage_text array<string>")
    assert readers.longest_answer(rows).first().answer == "bbb"
    assert readers.unselected_context(rows).first().context == ["p"]
    with pytest.raises(ValueError):
        readers.read(spark, "nothing", "x")


@pytest.mark.parametrize("kind", store.FORMATS)
def test_store(spark, tmp_path, kind):
    t = spark.createDataFrame([(1, "a", [1.5])], "mem_id long, text string, v array<double>")
    path = f"file://{tmp_path}/m"
    assert not store.exists(spark, path)
    store.save(path, {"texts": t}, MemoryConfig(), kind=kind, state={"variant": "text_scratchpad"})
    tables, state = store.load(spark, path, MemoryConfig())
    assert tables["texts"].collect() == t.collect() and state["variant"] == "text_scratchpad"
    with pytest.raises(store.IncompatibleMemory):
        store.load(spark, path, MemoryConfig(capacity=32))


def test_stream(spark, tmp_path):
    schema = "mem_id long, ord long, section_id long, text string, ts double"
    rows = [(1, 0, 0, "one two three. " * 5, 0.0), (2, 0, 0, "four", 0.0), (1, 1, 0, "five six.", 1.0)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        append.append(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", f"{tmp_path}/k").awaitTermination()
    got = append.latest(spark.read.parquet(f"{tmp_path}/c")).select("mem_id", "chunk_id", "text")
    want = ingest.number(ingest.chunks(ingest.place(spark.createDataFrame(rows, schema)), 24, 12)).select("mem_id", "chunk_id", "text")
    assert sorted(got.collect()) == sorted(want.collect())


def test_models():
    from memloom import models

    assert models.create("hashed:16") is models.create("hashed:16")
    assert models.create("hashed:16").info() == "hashed:16:1"
    with pytest.raises(ValueError):
        models.create("nothing")


def test_embedder_hook(spark):
    """Build and retrieve with a model of one's own: one that only sees the first token's length."""
    from memloom.config import MemoryConfig
    from memloom.models import Embedder

    def encode(rows):
        n = F.length(F.element_at(F.concat("tokens", F.array(F.lit(""))), 1)).cast("float")
        return rows.withColumn("embedding", F.array(n, F.lit(1.0).cast("float")))

    mine = Embedder("length", 2, encode, encode)
    texts = spark.createDataFrame([(1, 0, "abcdefgh one"), (1, 1, "ab two"), (1, 2, "abcde three")], "mem_id long, ord long, text string").withColumn("section_id", F.col("ord"))
    built = retrieve.build(texts, embedder=mine)
    got = retrieve.retrieve(built, spark.createDataFrame([(9, "xyzzy?")], "query_id long, query string"), 1, MemoryConfig(), embedder=mine).first()
    assert got.passage == "abcde three"


def test_importance_guard(spark):
    from memloom import models

    rows = spark.range(1)
    assert models.importance(rows, None, False) is rows
    with pytest.raises(RuntimeError):
        models.importance(rows, None, True)
    assert models.importance(rows, lambda r: r.withColumn("importance", F.lit(0.5)), True).first().importance == 0.5


def test_contrast_matcher(spark):
    from memloom import models

    df = spark.createDataFrame([([[0.0, 0.0]], [[1.0, 1.0], [0.0, 0.0]])], "query_keys array<array<double>>, passage_keys array<array<double>>")
    assert models.contrast_matcher()(df).first().confidence == pytest.approx(0.5 * 0.0066928509 + 1 - 0.0066928509)


def test_sessions(spark):
    from memloom.plans import sessions as s

    texts = spark.createDataFrame([(1, 0), (1, 4)], "mem_id long, ord long")
    new = s.new_sessions(texts, spark.createDataFrame([(1, "x"), (2, "y")], "mem_id long, session_id string")).collect()
    assert [(r.mem_id, r.ord, r.starts_section) for r in new] == [(1, 5, True)]
    m = spark.createDataFrame([("a", 0, "user", "hi", 1.0), ("a", 1, "assistant", "yo", 2.0)], "session_id string, turn long, role string, content string, ts double")
    users = spark.createDataFrame([("a", "and?"), ("b", "new")], "session_id string, content string")
    from memloom.models import TextModel

    out = s.reply(m, users, TextModel(F.upper, 2.0), memory=spark.createDataFrame([("a", "fact")], "session_id string, content string"), system=spark.createDataFrame([("a", "Be kind.")], "session_id string, content string"), now=F.lit(61.0))
    got = {r.session_id: r for r in out.collect()}
    assert [(x.role, x.content) for x in got["a"].messages] == [("system", "Be kind."), ("system", "fact"), ("user", "[1 minute(s) ago]\nhi"), ("assistant", "yo"), ("user", "and?")]
    assert got["b"].reply == "USER: NEW" and got["b"].cost == 2 * got["b"].prompt_tokens
    after = s.appended(m, users, out, F.lit(61.0))
    assert {(r.session_id, r.turn, r.role) for r in after.collect()} == {("a", 0, "user"), ("a", 1, "assistant"), ("a", 2, "user"), ("a", 3, "assistant"), ("b", 0, "user"), ("b", 1, "assistant")}
    assert {r.session_id for r in s.cleared(after, users.where("session_id = 'a'")).collect()} == {"b"} and s.cleared(after).isEmpty()
    back = s.from_state_text(s.state_text(after)).collect()
    assert sorted((r.session_id, r.turn, r.content) for r in back if r.session_id == "a") == [("a", 0, "hi"), ("a", 1, "yo"), ("a", 2, "and?"), ("a", 3, got["a"].reply)]


def test_merged_queries_lose_overlaps(spark):
    from memloom.plans import sessions as s

    rows = [("a", 1, 0.9, 0, 10), ("a", 2, 0.8, 5, 15), ("a", 3, 0.7, 20, 30), ("b", 4, 0.1, 0, 10)]
    df = spark.createDataFrame(rows, "session_id string, chunk_id long, relevance double, p_from long, p_to long")
    assert sorted(r.chunk_id for r in s.deoverlapped(df).collect()) == [1, 3, 4]


def test_text_helpers(spark):
    r = spark.createDataFrame([("ab c\nlast line with many words in it", [3.0, 4.0], [0.0, 0.0])], "t string, v array<double>, z array<double>").select(
        T.after_last_line(F.col("t")).alias("a"), T.after_last_line(F.lit("ab\ncd")).alias("b"), T.token_at(F.array(F.lit("ab"), F.lit(" ")), F.lit(2)).alias("c"), T.token_at(F.array(F.lit("ab")), F.lit(2)).alias("d"), S.normalized(F.col("v")).alias("e"), S.softmax(F.col("z")).alias("f"), T.within_length(F.lit("x")).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.g) == ("last line with many words in it", "ab\ncd", 1, -1, "x") and r.e == [0.6, 0.8] and r.f == [0.5, 0.5]
    with pytest.raises(Exception, match="2048"):
        spark.range(1).select(T.within_length(F.repeat(F.lit("x"), 2048))).collect()


def test_negative_passages(spark):
    from memloom.sources import questions as Q

    df = spark.createDataFrame([(100, 50, True, 0.5), (100, 90, True, 0.0), (30, 15, True, 0.5), (100, 50, False, 0.999)], "n long, a long, same boolean, chance double")
    got = [r[0] for r in df.select(Q.negative_start(F.col("n"), F.col("a"), 10, 20, F.col("same"), F.col("chance"))).collect()]
    assert got == [80, 0, None, 90]
