"""Retrieval: queries to vectors, nearest chunks, passages, matching, removal of overlaps, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..config import Decay, MemoryConfig
from ..functions import scores as S
from ..functions import text as T
from ..models import Embedder, hashed_embedder
from ..operators import ingest, passages, vectors

#: So many hits are sent to all tasks that read the chunks.
BROADCAST_HITS = 100_000

Match = Callable[[DataFrame], DataFrame]
"""Adds `confidence` to rows (query_id, query, text, ...)."""
Rerank = Callable[[DataFrame], DataFrame]
"""Adds `score`, higher is better, to rows of found memories."""


def build(texts: DataFrame, config: MemoryConfig | None = None, separator: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Chunks of texts(mem_id, ord, text, ...), numbered, retained and embedded by the embedder, or by hashed tokens."""
    config = config or MemoryConfig()
    placed = ingest.place(texts, separator=separator)
    out = ingest.retain(ingest.number(ingest.chunks(placed, config.capacity, config.stride)), config.queue)
    return (embedder or hashed_embedder()).encode_corpus(out)


def recency_rerank(now: float, half_life: float, decay: Decay = Decay.EXPONENTIAL, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), multiplicative: bool = False, use_importance: bool = True) -> Rerank:
    """Score by recency, importance and relevance."""
    return lambda rows: rows.withColumn("score", S.memory_score(S.recency(F.lit(now) - F.col("ts"), half_life, decay), F.col("importance") if use_importance else None, F.col("relevance"), weights, multiplicative))


def embedding_match(rows: DataFrame) -> DataFrame:
    """Confidence from the distance of the embeddings."""
    return rows.withColumn("confidence", S.match_probability(F.col("distance")))


def retrieve(chunked: DataFrame, queries: DataFrame, k: int, config: MemoryConfig | None = None, match: Match | None = None, rerank: Rerank | None = None, rewrite: Callable | None = None, embedder: Embedder | None = None, near: Callable[[DataFrame], DataFrame] | None = None, decode: Callable | None = None) -> DataFrame:
    """The k best memories of each query(query_id, query): query_id, rank, chunk_id, passage, bounds, ts, distance, relevance, confidence, importance, text_keys, metadata.

    chunked holds one memory. A null or blank query still finds the nearest chunks. rewrite maps the query
    column before it is cut to its last tokens. near(rows with chunk_id) lays out only the memories that have
    those chunks; without it chunked is read again for the hits. decode: as nearest() has it.
    """
    config = config or MemoryConfig()
    n_rerank, n_expand, n_find = config.sizes(k, match is not None or rerank is not None)
    text = F.coalesce(F.col("query"), F.lit(""))
    q = queries.withColumn("query", rewrite(text) if rewrite else text)
    q = (embedder or hashed_embedder()).encode_queries(q.withColumn("tokens", T.last_tokens(T.tokens(F.col("query")), config.max_query_tokens)))
    hits = vectors.nearest(chunked, q.select("query_id", "embedding"), n_find, id_col="chunk_id", decode=decode).where(F.col("rank") <= n_expand).persist(StorageLevel.DISK_ONLY)
    few = F.broadcast if hits.count() <= BROADCAST_HITS else lambda rows: rows
    # From here on the chunks of the hits stand for all; of the others only the tiles of passages are read.
    ids = few(hits.select("chunk_id").distinct())
    tiles = near(ids).persist(StorageLevel.DISK_ONLY) if near else chunked.drop("embedding")
    chunked = tiles.join(ids, "chunk_id", "left_semi").persist(StorageLevel.DISK_ONLY)
    hits = hits.join(chunked.select("mem_id", "section_id", "chunk_id", "from_seq", "to_seq", "section_from", "section_to", "first_seq"), "chunk_id")
    rows = passages.expand(hits, tiles, config.expansion, config.stride, few=few).withColumn("ord", F.struct("distance", "chunk_id"))
    rows = rows.select("query_id", "chunk_id", "distance", "ord", "p_from", "p_to", "passage")
    confidence = F.lit(None).cast("double")
    if match:
        rows = passages.greedy(rows, config.threshold, n_rerank, keep_overlaps=True)
        rows = match(rows.join(chunked.select("chunk_id", "text"), "chunk_id").join(q.select("query_id", "query"), "query_id"))
        rows = rows.withColumn("ord", F.struct((-F.col("confidence")).alias("distance"), "chunk_id")).drop("text", "query")
        confidence = F.col("confidence")
    rows = passages.greedy(rows, config.threshold, n_rerank if match or rerank else k).withColumn("confidence", confidence)
    rows = rows.join(chunked.select("chunk_id", "ts", "importance", "metadata", "text_keys"), "chunk_id")
    rows = rows.withColumn("relevance", S.relevance(F.col("distance"), F.col("confidence"))).withColumn("passage", F.trim("passage"))
    by = F.col("ord")
    if rerank:
        rows = rerank(rows)
        by = F.struct((-F.col("score")).alias("distance"), "chunk_id")
    w = Window.partitionBy("query_id").orderBy(by)
    out = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "chunk_id", "passage", F.col("p_from").alias("from_idx"), F.col("p_to").alias("to_idx"), "ts", "distance", "relevance", "confidence", "importance", "text_keys", "metadata")
