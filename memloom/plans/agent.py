"""Prompts within a token budget: history, memory excerpts, system and user text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CONVERSATION_PREFIX = "Excerpts from earlier conversation:\n"
KNOWLEDGE_PREFIX = "Excerpts from the knowledge base:\n"


def history(messages: DataFrame, budget: int, base: Column | None = None, session: str = "session_id") -> DataFrame:
    """The newest messages(session, turn, role, content) whose tokens, with `base`, stay within the budget. A sum of counts only grows, so a filter is the loop's stop."""
    w = Window.partitionBy(session).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("n_tokens").over(w) + (base if base is not None else F.lit(0))
    return messages.withColumn("n_tokens", T.token_count(F.col("content"))).withColumn("used", used).where(F.col("used") <= budget)


def last_assistant(messages: DataFrame, session: str = "session_id") -> DataFrame:
    return messages.where("role = 'assistant'").groupBy(session).agg(F.max_by("content", "turn").alias("content"))


def visible_memories(memories: DataFrame, cutoff: Column) -> DataFrame:
    """Memories older than the visible history; applied after the search."""
    return memories.where(F.col("ts") < cutoff)


def excerpts(memories: DataFrame, budget: int, now: Column | None = None, session: str = "session_id") -> DataFrame:
    """memories(session, kind, relevance, tie, ts, from_idx, passage) that fit, most relevant first, with the excerpt text.

    The first of each kind (convo or kb) also pays for that kind's heading.
    """
    body = F.trim("passage")
    when = T.elapsed(F.col("ts"), now) if now is not None else F.lit("just now")
    text = F.when(F.col("kind") == "convo", F.concat(F.lit("# Excerpt from "), when, F.lit("\n"), body, F.lit("\n\n"))).otherwise(F.concat(F.lit("# Excerpt\n"), body, F.lit("\n\n")))
    by = [F.desc("relevance"), F.col("kind"), F.col("tie")]
    first = F.row_number().over(Window.partitionBy(session, "kind").orderBy(*by)) == 1
    prefix = F.when(F.col("kind") == "convo", T.token_count(F.lit(CONVERSATION_PREFIX))).otherwise(T.token_count(F.lit(KNOWLEDGE_PREFIX)))
    rows = memories.withColumn("excerpt", text).withColumn("cost", T.token_count(F.col("excerpt")) + F.when(first, prefix).otherwise(0))
    w = Window.partitionBy(session).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def memory_message(fitting: DataFrame, session: str = "session_id") -> DataFrame:
    """session and the text of its excerpts: knowledge by place, then conversation by time."""
    g = fitting.groupBy(session).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "kb", F.struct(F.col("from_idx").cast("double"), "tie", "excerpt")))).alias("kb"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "convo", F.struct("ts", "tie", "excerpt")))).alias("convo"),
    )

    def part(c: str, prefix: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(prefix), F.array_join(F.transform(c, lambda x: x["excerpt"]), "\n"))).otherwise("")

    return g.select(session, F.concat(part("kb", KNOWLEDGE_PREFIX), part("convo", CONVERSATION_PREFIX)).alias("content"))


def assemble(system: DataFrame, memory: DataFrame, shown: DataFrame, user: DataFrame, session: str = "session_id") -> DataFrame:
    """One prompt a session: system, memory, history from old to new, user, as an array of roles and contents."""
    row = lambda t, at, role, turn: t.select(session, F.lit(at).alias("at"), turn.cast("long").alias("turn"), role.alias("role"), "content")
    rows = row(system, 0, F.lit("system"), F.lit(0)).unionByName(row(memory.where("content <> ''"), 1, F.lit("system"), F.lit(0)))
    rows = rows.unionByName(row(shown, 2, F.col("role"), F.col("turn"))).unionByName(row(user, 3, F.lit("user"), F.lit(0)))
    return rows.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
