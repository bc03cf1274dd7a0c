"""The corpus pipeline: five stages from documents to packed pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of documents, the last one the pieces. SQL cannot express the stages. tests/llm compare the
operators with brute force; of the stages themselves they check columns and that rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import langid, minhash, mixing, packing, scratch, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this score a text's n-grams are nearly all foreign to every learned language.
MIN_LANG_SCORE = 0.25
#: Near copies in percent of shared shingles; op9's own 85 is that query's contract alone.
NEAR_COPY = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a learned language; a missing lang becomes the predicted one. Null and letterless texts go.

    A table in which no row has a lang teaches no language, so nothing stays. Repeated rows stay or go
    together; equally near languages rank by name.
    """
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows with null ids come last, and equal rows arbitrarily.

    Texts without words are copies of nothing and stay. An empty table gives an empty one. Where ids
    repeat or are null, rows are numbered first, so one row of a group stays, whatever its id.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        kept = minhash.near_groups(docs, num=NEAR_COPY).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    numbered = scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = minhash.near_groups(numbered, num=NEAR_COPY, id_col="__row").select("__row", "component_id")
    first = F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__row")
    kept = numbered.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(first).select("__row")
    return numbered.join(kept, "__row", "left_semi").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier in the corpus; a text of which no word is left goes.

    A null text has no passages and stays as it is. Rows are in order of id, null ids last; rows of one
    id in order of a hash of the text, so of repeated rows one keeps its passages.
    """
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    left = found.where("n_removed = 0 or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: each at least once, none more than the repetition limit rounded up.

    Null sources are one source. Null and empty texts have no tokens and come once in each whole epoch.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the curve; a row that the mix repeats has pieces for each copy.

    A null text is its end id alone. Equal rows follow each other in any order, with the same pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
