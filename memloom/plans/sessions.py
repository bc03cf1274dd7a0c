"""Turns of an agent, for all sessions at once: context, reply, messages and memory, profile and state."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonfix
from ..functions import text as T
from ..models import TextModel
from . import agent


class Variant(Enum):
    """How a turn finds what it asks the memory: by the text alone, with generated queries and a profile, or with a scratchpad."""

    SEMANTIC = "semantic"
    QUERIES_PROFILE = "queries_profile"
    SCRATCHPAD = "scratchpad"


PROFILE_HEAD = "Current information about the user:\n"
PAD_HEAD = "Current scratchpad content (world model, user info):\n"


def new_sessions(texts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Empty rows that open a section in each memory of sessions(mem_id, session_id) that has texts(mem_id, ord)."""
    last = texts.groupBy("mem_id").agg((F.max("ord") + 1).alias("ord"))
    return sessions.join(last, "mem_id").select("mem_id", "ord", F.lit("").alias("text"), F.lit(True).alias("starts_section"), "session_id")


def message_count(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("turn").alias("n_messages"))


def system_content(state: DataFrame, variant: Variant, template: str = "") -> DataFrame:
    """session_id and content from state(session_id, profile map, scratchpad): the template, then what the variant knows."""
    if variant is Variant.QUERIES_PROFILE:
        known = F.when(F.size("profile") > 0, F.concat(F.lit(PROFILE_HEAD), T.indented_json(F.col("profile"))))
    elif variant is Variant.SCRATCHPAD:
        known = F.when(F.length("scratchpad") > 0, F.concat(F.lit(PAD_HEAD), F.col("scratchpad")))
    else:
        known = F.lit(None).cast("string")
    return state.select("session_id", F.concat_ws("\n\n", F.lit(template or None).cast("string"), known).alias("content"))


def generated_queries(completions: DataFrame) -> DataFrame:
    """completions(session_id, completion, ...) with queries, and profile: JSON of the new one, null where it stays.

    What is no JSON object gives no queries and no profile.
    """
    fixed = completions.withColumn("__json", jsonfix.repaired(F.col("completion")))
    ok = F.col("__json").rlike(r"^\s*\{")
    return fixed.withColumn("queries", F.when(ok, F.coalesce(F.from_json(F.get_json_object("__json", "$.queries"), "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).withColumn("profile", F.when(ok, F.get_json_object("__json", "$.user"))).drop("__json")


def updated_state(state: DataFrame, found: DataFrame, variant: Variant) -> DataFrame:
    """state with each session's new profile or scratchpad; what was not found stays."""
    if variant is Variant.SEMANTIC:
        return state
    col = "profile" if variant is Variant.QUERIES_PROFILE else "scratchpad"
    fresh = found.select("session_id", F.col(col).alias("__new"))
    return state.join(fresh, "session_id", "left").withColumn(col, F.coalesce("__new", col)).drop("__new")


def memory_queries(users: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """query_id, session_id, query: "user: " and the turn's text, then the generated ones."""
    own = users.select("session_id", F.lit(0).alias("n"), F.concat(F.lit("user: "), "content").alias("query"))
    if generated is not None:
        own = own.unionByName(generated.select("session_id", F.posexplode("queries").alias("n", "query")).withColumn("n", F.col("n") + 1))
    return own.select(F.concat_ws("/", "session_id", "n").alias("query_id"), "session_id", "query")


def shown_history(messages: DataFrame, users: DataFrame, system: DataFrame, budget: int, now: Column) -> DataFrame:
    """The newest messages(session_id, turn, role, content, ts), user turns below their age, that fit beside the system and user text."""
    fixed = users.select("session_id", F.col("content").alias("__user")).join(system.select("session_id", F.col("content").alias("__system")), "session_id", "left")
    rows = messages.withColumn("content", T.heading(F.col("role"), F.col("content"), F.col("ts"), now)).join(fixed, "session_id")
    base = T.token_count(F.coalesce("__user", F.lit(""))) + T.token_count(F.coalesce("__system", F.lit("")))
    return agent.history(rows, budget, base).drop("__user", "__system")


def reply(messages: DataFrame, users: DataFrame, model: TextModel, memory: DataFrame | None = None, system: DataFrame | None = None, budget: int = 2048, now: Column | None = None) -> DataFrame:
    """users(session_id, content) answered: session_id, messages (the prompt), prompt_tokens, cost, reply.

    memory(session_id, content) holds the excerpts; the model sees the prompt as one text.
    """
    now = now if now is not None else F.current_timestamp().cast("double")
    none = users.select("session_id", F.lit("").alias("content")).where("false")
    system = none if system is None else system.where("content <> ''")
    shown = shown_history(messages, users, system, budget, now)
    prompts = agent.assemble(system, none if memory is None else memory, shown, users)
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    out = prompts.withColumn("__prompt", text).withColumn("prompt_tokens", T.token_count(F.col("__prompt")))
    return out.withColumn("cost", F.col("prompt_tokens") * F.lit(model.cost_per_token)).withColumn("reply", model.generate(F.col("__prompt"))).drop("__prompt")


def appended(messages: DataFrame, users: DataFrame, replies: DataFrame, ts: Column) -> DataFrame:
    """messages with each answered session's user turn and reply; the same two rows go to the conversation memory."""
    last = messages.groupBy("session_id").agg(F.max("turn").alias("__last"))
    both = users.join(replies.select("session_id", "reply"), "session_id").join(last, "session_id", "left")
    turn = F.coalesce("__last", F.lit(-1)) + 1
    row = lambda role, c, k: F.struct((turn + k).cast(dict(messages.dtypes)["turn"]).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("content"))
    new = both.select("session_id", F.explode(F.array(row("user", "content", 0), row("assistant", "reply", 1))).alias("m"))
    return messages.select("session_id", "turn", "role", "content", "ts").unionByName(new.select("session_id", "m.turn", "m.role", "m.content", ts.cast("double").alias("ts")))


def cleared(table: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A table without the rows of some sessions, or without any."""
    return table.where("false") if sessions is None else table.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def state_text(messages: DataFrame) -> DataFrame:
    """session_id and its messages as JSON, in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return messages.groupBy("session_id").agg(F.to_json(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("state"))


def from_state_text(states: DataFrame) -> DataFrame:
    """Messages of session_id and state."""
    rows = F.from_json("state", "array<struct<role:string,content:string>>")
    return states.select("session_id", F.posexplode(rows).alias("turn", "m")).select("session_id", "turn", "m.role", "m.content")


def dump(chunks: DataFrame) -> DataFrame:
    """A line of a Markdown table for each chunk(mem_id, chunk_id, metadata, importance, text)."""
    quoted = F.to_json(F.struct(F.col("text").alias("x")))
    content = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    cells = [F.col("chunk_id").cast("string"), F.coalesce(F.col("metadata").cast("string"), F.lit("None")), F.coalesce(F.round("importance", 2).cast("string"), F.lit("None")), content]
    return chunks.select("mem_id", "chunk_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def deoverlapped(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The hits of several queries of a session as one list, most relevant first, without overlaps; as many as are left."""
    from ..operators import passages

    rows = found.withColumn("ord", F.struct((-F.col("relevance")).alias("r"), "chunk_id"))
    return passages.greedy(rows, threshold, 1 << 30, group="session_id")


Hook = Callable[[DataFrame], DataFrame]


def newest(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
