"""Sources of texts, questions and facts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def conversation_lines(messages: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as texts: "role: text" and a line end; a conversation is a section."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return messages.select(F.col("conv_id").alias("mem_id"), F.col("turn").alias("ord"), line.alias("text"), F.lit(0).cast("long").alias("section_id"), F.col("turn").cast("double").alias("ts"))


def knowledge(docs: DataFrame) -> DataFrame:
    """documents as texts, each a memory and a section of its own."""
    return docs.select(F.col("doc_id").alias("mem_id"), F.lit(0).cast("long").alias("ord"), "text", F.lit(0).cast("long").alias("section_id"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows, dealt out by a key where fewer than two tasks a core would read them, as from a file of one row group. Only footers are read to tell."""
    filled = rows.select(F.spark_partition_id()).distinct().count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if filled >= 2 * cores else rows.repartition(4 * cores, key)


def long_articles(docs: DataFrame, least: int = 512) -> DataFrame:
    return docs.where(F.length("text") >= least)


def first_question(rows: DataFrame) -> DataFrame:
    """story, questions[], answers[] to the first question and answer; empty answers go."""
    return rows.select("story", F.element_at("questions", 1).alias("question"), F.element_at("answers", 1).alias("answer")).where("answer <> ''")


def snippets(rows: DataFrame) -> DataFrame:
    """Rows with a snippet, without the marks that open it."""
    return rows.where("snippet <> ''").withColumn("snippet", F.trim(F.regexp_replace("snippet", "^#+", "")))


def longest_answer(rows: DataFrame) -> DataFrame:
    """query_id and its longest of answers[]; the first of equal length."""
    x = rows.select("query_id", F.posexplode("answers").alias("pos", "answer"))
    return x.groupBy("query_id").agg(F.max_by("answer", F.struct(F.length("answer"), -F.col("pos"))).alias("answer"))


def unselected_context(rows: DataFrame) -> DataFrame:
    """query_id and passages that were not selected; null if none was selected."""
    z = F.arrays_zip("is_selected", "passage_text")
    rest = F.transform(F.filter(z, lambda x: x["is_selected"] == 0), lambda x: x["passage_text"])
    return rows.select("query_id", F.when(F.exists("is_selected", lambda s: s == 1), rest).alias("context"))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order of the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "json": lambda s, p: s.read.json(p, multiLine=True),
    "jsonl": lambda s, p: s.read.json(p),
    "text": lambda s, p: s.read.text(p, wholetext=True).withColumnRenamed("value", "text"),
    "csv": lambda s, p: s.read.csv(p, header=True, inferSchema=True),
    "binary": lambda s, p: s.read.format("binaryFile").load(p),
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A source by its kind; ValueError for an unknown one."""
    if kind not in _READERS:
        raise ValueError(f"no source of kind {kind}: {', '.join(_READERS)}")
    return _READERS[kind](spark, path)
