"""Queries of agents, models, questions and edits over the test tables, and their SQL; they join those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scores as S
from .functions import text as T
from .models import TextModel
from .operators import ingest
from .plans import sessions
from .queries import DOC_TOK, STRIDE, TOK, C, _doc_placed, _messages, query, table
from .sources import questions as Q
from .sources import readers

FRACTION = "(('0x' || substr(md5('{seed}-' || {key}), 1, 8))::bigint / 4294967296.0)"
MEAN_SQ = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::double - {b}[i]::double) ** 2)) / len({a})"


def _digest(c):
    return F.md5(F.coalesce(c, F.lit("")).cast("binary"))


# Models.
@query(f"select a.vec_id, round(0.5 / (1 + exp(5)) + exp(-{MEAN_SQ.format(a='a.embedding', b='b.embedding')} * 4) * (1 - 1 / (1 + exp(5))), 6) as probability from embeddings a, embeddings b where a.vec_id % 7 = 0 and b.vec_id = a.vec_id + 1")
def contrast_probability(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.array("embedding").alias("s"))
    rows = e.where("vec_id % 7 = 0").select("vec_id", F.array("embedding").alias("r")).join(near, "vec_id")
    return rows.select("vec_id", F.round(S.contrast_probability(S.least_mean_square(F.col("r"), F.col("s")), 2.0), 6).alias("probability"))


@query(f"select a.vec_id // 4 as memory, round(min({MEAN_SQ.format(a='a.embedding', b='b.embedding')}), 6) as distance from embeddings a, embeddings b where a.vec_id // 4 + 1 = b.vec_id // 4 group by 1")
def multi_key_distance(spark, sf_dir):
    """Least mean square between the vectors of a memory and those of the next."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").groupBy(F.expr("vec_id div 4").alias("memory")).agg(F.collect_list("embedding").alias("r"))
    near = e.select((F.col("memory") - 1).alias("memory"), F.col("r").alias("s"))
    return e.join(near, "memory").select("memory", F.round(S.least_mean_square(F.col("r"), F.col("s")), 6).alias("distance"))


# Memories.
@query(DOC_TOK + "select mem_id, chunk_no from k where chunk_no % 3 = 0 or to_seq - from_seq < 24")
def dirty_chunks(spark, sf_dir):
    """Chunks to embed where two of three are indexed, as if all were full."""
    k = ingest.bounds(_doc_placed(spark, sf_dir), C, STRIDE)
    done = k.where("chunk_no % 3 <> 0").select("mem_id", "section_id", "chunk_no", F.lit(24).cast("long").alias("n_indexed"))
    return ingest.dirty_chunks(k, done).select("mem_id", "chunk_no")


EDITED = f"with m as (select conv_id as mem_id, turn, role || ': ' || case when turn % 5 = 2 then 'an edited turn' else coalesce(text, '') end || chr(10) as text, role || ': ' || coalesce(text, '') || chr(10) as old from conversations), s as (select mem_id, string_agg(text, '' order by turn) as text, string_agg(old, '' order by turn) as old from m where mem_id in (select conv_id from conversations where turn % 5 = 2) group by 1), t as (select mem_id, {TOK} as tok, {TOK.replace('text', 'old').replace('old_', 'text_')} as otok from s), c as (select mem_id, unnest(range(0, ((len(tok) + 11) // 12)::bigint)) as i, tok, otok from t) select mem_id, i as chunk_no, md5(array_to_string(tok[i * 12 + 1 : i * 12 + 24], '')) as digest, not (i < (len(otok) + 11) // 12 and tok[i * 12 + 1 : i * 12 + 24] = otok[i * 12 + 1 : i * 12 + 24]) as changed from c"


@query(EDITED)
def text_edits(spark, sf_dir):
    """Chunks after many edits of each conversation, and which of them changed."""
    texts = readers.conversation_lines(table(spark, sf_dir, "conversations")).withColumn("text_key", F.col("ord").cast("long"))
    role = table(spark, sf_dir, "conversations").where("turn % 5 = 2").select(F.col("conv_id").alias("mem_id"), F.col("turn").cast("long").alias("text_key"), F.concat("role", F.lit(": an edited turn\n")).alias("text"))
    out = ingest.edited(texts, role, 24, 12)
    return out.select("mem_id", "chunk_no", F.md5(F.col("text").cast("binary")).alias("digest"), "changed")


@query(f"select doc_id, case when length(text) > 100 then len(regexp_extract_all(substr(text, 1, 101), '{TOK.split(chr(39))[3]}', 1))::bigint - 1 else -1 end as token from documents where text is not null")
def token_at_offset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.token_at(T.tokens(F.col("text")), F.lit(100)).alias("token"))


@query("select doc_id, md5(regexp_extract(substr(text, 1, greatest(length(text) - 18, 0)), '([^\\n]*)$', 1) || substr(text, greatest(length(text) - 18, 0) + 1)) as digest from documents where text is not null")
def last_line_attention(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", _digest(T.after_last_line(F.col("text"))).alias("digest"))


# Agents.
AGE = "(turn * 977 % 90000 + 0.5)"


@query(f"with m as (select conv_id as session_id, turn, role, text, {AGE}::double as s from conversations) select session_id, turn, md5(case when role = 'user' then '[' || case when s < 1 then 'just now' when s < 60 then round_even(s, 0)::bigint || ' second(s) ago' when s < 3600 then round_even(s / 60, 0)::bigint || ' minute(s) ago' when s < 86400 then printf('%.1f', s / 3600) || ' hour(s) ago' else printf('%.1f', s / 86400) || ' day(s) ago' end || ']' || chr(10) || text else text end) as digest from m where text is not null")
def message_heading(spark, sf_dir):
    m = _messages(spark, sf_dir).where("content is not null")
    age = F.expr("cast(turn * 977 % 90000 + 0.5 as double)")
    return m.select("session_id", "turn", _digest(T.heading(F.col("role"), F.col("content"), F.lit(0.0), age)).alias("digest"))


def _state(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    profile = F.create_map(F.lit("name"), F.col("c_name"), F.lit("age"), (F.col("c_custkey") % 90).cast("string"))
    profile = F.when(F.col("c_custkey") % 3 > 0, profile).otherwise(F.create_map().cast("map<string,string>"))
    return c.select(F.col("c_custkey").alias("session_id"), profile.alias("profile"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("scratchpad"))


@query("""select c_custkey as session_id, 'Be kind.' || case when c_custkey % 3 > 0 then chr(10) || chr(10) || 'Current information about the user:' || chr(10) || '{' || chr(10) || '   "age": "' || c_custkey % 90 || '",' || chr(10) || '   "name": "' || c_name || '"' || chr(10) || '}' else '' end as content from customer""")
def system_content(spark, sf_dir):
    return sessions.system_content(_state(spark, sf_dir), sessions.Variant.QUERIES_PROFILE, "Be kind.")


@query("select c_custkey as session_id, case when c_custkey % 5 = 0 then case when c_custkey % 4 > 0 then c_name end else chr(10) || 'pad ' || c_custkey || chr(10) end as scratchpad from customer")
def scratchpad_update(spark, sf_dir):
    state = _state(spark, sf_dir)
    answer = F.when(F.col("session_id") % 5 == 0, F.lit("nothing new")).otherwise(F.concat(F.lit("So:\n"), T.fenced(F.concat(F.lit("pad "), F.col("session_id").cast("string"))), F.lit("\nDone.")))
    found = state.select("session_id", T.scratchpad(answer).alias("scratchpad"))
    return sessions.updated_state(state, found, sessions.Variant.SCRATCHPAD).select("session_id", "scratchpad")


@query("select c_custkey || '/0' as query_id, 'user: hello ' || c_custkey as query from customer union all select c_custkey || '/1', 'about ' || c_custkey from customer where c_custkey % 7 > 0 union all select c_custkey || '/2', 'and ' || c_name from customer where c_custkey % 7 > 0")
def generated_queries(spark, sf_dir):
    """Queries of each turn, the generated ones from fenced JSON with a trailing comma; a seventh of the answers is no JSON."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    good = F.concat(F.lit('```json\n{"queries": ["about '), k, F.lit('", "and '), F.col("c_name"), F.lit('"], "user": {"id": '), k, F.lit("},}\n```"))
    answers = c.select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 7 > 0, good).otherwise(F.lit("no idea")).alias("completion"))
    users = c.select(F.col("c_custkey").alias("session_id"), F.concat(F.lit("hello "), k).alias("content"))
    return sessions.memory_queries(users, sessions.generated_queries(answers)).select("query_id", "query")


@query(f"with m as (select conv_id as session_id, turn, role, coalesce(text, '') as text from conversations), n as (select *, len({TOK}) as n from m), h as (select *, sum(n) over (partition by session_id order by turn desc) + 4 as used from n), p as (select session_id, string_agg(role || ': ' || text, chr(10) order by turn) || chr(10) || 'user: and then?' as p from h where used <= 150 and role <> 'user' group by 1), q as (select session_id, max(turn) as last, count(*) as n from m group by 1) select q.session_id, q.last + 2 as turn, q.n + 2 as n_messages, 'assistant' as role from q")
def agent_turn(spark, sf_dir):
    """Every session answered once by a model that repeats its prompt's last line: the last message and the count after the turn."""
    m = _messages(spark, sf_dir).select("session_id", "turn", "role", F.coalesce("content", F.lit("")).alias("content"), F.lit(0.0).alias("ts"))
    users = m.select("session_id").distinct().withColumn("content", F.lit("and then?"))
    model = TextModel(lambda p: F.substring_index(p, "\n", -1), 0.001)
    out = sessions.reply(m, users, model, budget=150, now=F.lit(60.0))
    after = sessions.appended(m, users, out, F.lit(60.0))
    last = after.groupBy("session_id").agg(F.max_by(F.struct("turn", "role"), "turn").alias("l"))
    return sessions.message_count(after).join(last, "session_id").select("session_id", F.col("l.turn").alias("turn"), "n_messages", F.col("l.role").alias("role"))


@query("select conv_id as session_id, md5(to_json(list({'role': role, 'content': text} order by turn))) as digest from conversations where text is not null group by 1")
def session_state(spark, sf_dir):
    return sessions.state_text(_messages(spark, sf_dir).where("content is not null")).select("session_id", _digest(F.col("state")).alias("digest"))


@query("select conv_id as session_id, turn, role, text as content from conversations where text is not null qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def newest_messages(spark, sf_dir):
    return sessions.newest(_messages(spark, sf_dir).where("content is not null"), 2).select("session_id", "turn", "role", "content")


@query("select doc_id as mem_id, doc_id as chunk_id, md5('| ' || doc_id || ' | ' || coalesce(source, 'None') || ' | None | ' || to_json(text) || ' |') as digest from documents where text is not null")
def memory_dump(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    k = d.select(F.col("doc_id").alias("mem_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("metadata"), F.lit(None).cast("double").alias("importance"), "text")
    return sessions.dump(k).select("mem_id", "chunk_id", _digest(F.col("line")).alias("digest"))


@query("select n_nationkey, 'fact ' || n_nationkey || chr(10) || n_name as memory, 'about ' || n_name as query from nation")
def rewritten_texts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    memory = F.to_json(F.struct(F.create_map(F.lit("a"), F.concat(F.lit("fact "), F.col("n_nationkey").cast("string")), F.lit("b"), F.col("n_name")).alias("processed")))
    asked = F.to_json(F.struct(F.concat(F.lit("about "), "n_name").alias("processed")))
    return n.select("n_nationkey", T.processed_values(memory).alias("memory"), T.processed_query(asked).alias("query"))


# Questions.
QA = "with q as (select conv_id as id, max(case when turn = 0 then text end) as question, max(case when turn = 1 then text end) as answer, max(case when turn = 2 then text end) as context from conversations group by 1) "


def _qa(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(at(0).alias("question"), at(1).alias("answer"), at(2).alias("context"))


@query(QA + "select id, md5(context) as context, md5(answer) as fact, md5(question) as question from q where answer <> '' and question <> '' and context is not null")
def question_scenarios(spark, sf_dir):
    rows = _qa(spark, sf_dir).withColumn("context", F.when(F.col("context").isNotNull(), F.array("context"))).withColumn("rewrite", F.lit(None).cast("string"))
    s = Q.evaluator("rewritten")(rows)
    return s.select("id", _digest(F.element_at("context", 1)).alias("context"), _digest(F.element_at("facts", 1)).alias("fact"), _digest(F.col("question")).alias("question"))


@query(QA + "select id, 0 as n, md5(answer) as fact from q where question <> '' and answer is not null")
def stored_facts(spark, sf_dir):
    rows = _qa(spark, sf_dir).where("answer is not null").select("id", "question", F.col("context").alias("description"), F.array("answer", "question").alias("facts"))
    return Q.stored_facts(Q.evaluator("strategy")(rows, 1)).select("id", "n", _digest(F.col("fact")).alias("fact"))


@query(f"with t as (select doc_id, {TOK} as tok from documents) select doc_id, (40 - 20 + coalesce(list_max(list_transform(range(1, 21), lambda i: case when tok[20 + i] in ('.', '!', '?') then i end)), 0))::integer as start from t where len(tok) > 60")
def answer_snapping(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tok")).where(F.size("tok") > 60)
    return d.select("doc_id", Q.snapped_start(F.col("tok"), F.lit(40), 20).cast("int").alias("start"))


@query(f"with r as (select item_id, md5('3-' || item_id) as d from benchmark), k as (select item_id, coalesce(lead(item_id) over (order by d, item_id), first_value(item_id) over (order by d, item_id)) as nxt from r) select item_id, case when {FRACTION.format(seed=4, key='item_id')} < 0.5 then nxt else item_id end as other from k")
def negative_entries(spark, sf_dir):
    return Q.negatives(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 3)


@query("(select doc_id, 'a' as source_name from documents where lang = 'en' order by md5('5-' || doc_id), doc_id limit 60) union all (select doc_id, 'b' from documents where lang = 'de' order by md5('5-' || doc_id), doc_id limit 20)")
def weighted_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    of = lambda lang: d.where(F.col("lang") == lang).select("doc_id")
    return Q.weighted({"a": (of("en"), 3.0), "b": (of("de"), 1.0)}, 80, "doc_id", 5)


@query(f"with n as (select n_name, row_number() over (order by n_name) - 1 as n from (select distinct n_name from nation where length(n_name) <= 10)) select c_custkey, n_name from customer, n where n = floor({FRACTION.format(seed=6, key='c_custkey')} * (select count(*) from n))")
def random_names(spark, sf_dir):
    numbered = Q.names(table(spark, sf_dir, "nation"), "n_name")
    return Q.named(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", numbered, 6).select("c_custkey", "n_name")


@query("with m as (select r_regionkey, unnest(range(0, 3)) as r from region) select r_regionkey from m order by r, md5('7-' || r_regionkey), r_regionkey limit 12")
def index_sample(spark, sf_dir):
    """Twelve of five keys: with repetition, as there are too few."""
    return Q.sample_indexes(table(spark, sf_dir, "region"), "r_regionkey", 12, 7)


@query(f"select doc_id from documents where {FRACTION.format(seed=0, key='doc_id')} < 0.8")
def training_split(spark, sf_dir):
    return Q.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")[0]


@query(f"with x as (select conv_id as id, list(text order by turn) as c from conversations where text is not null group by 1), s as (select id, array_to_string(c[greatest(len(c) - 2, 1) :], chr(10)) || chr(10) || 'Ann: why?' as text from x), t as (select id, {TOK} as tok from s) select id, md5(array_to_string(tok[greatest(len(tok) - 39, 1) :], '')) as digest from t")
def speaker_query(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").where("text is not null").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("context"))
    return Q.speaker_query(g.withColumn("question", F.lit("why?")).withColumn("name", F.lit("Ann"))).select("id", _digest(F.col("query")).alias("digest"))


@query("select o_orderkey, '{\"__type__\":\"datetime\",\"value\":\"' || strftime(o_orderdate::timestamp, '%Y-%m-%dT%H:%M:%S') || '\"}' as tagged, true as same from orders")
def tagged_time(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", T.tagged_time(F.col("t")).alias("tagged"), (T.from_tagged_time(T.tagged_time(F.col("t"))) == F.col("t")).alias("same"))
