"""Streams of texts into a chunk table: each micro-batch lays out only the memories it touches anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MemoryConfig
from ..operators import ingest


def append(stream: DataFrame, texts_path: str, chunks_path: str, checkpoint: str, config: MemoryConfig | None = None) -> StreamingQuery:
    """Append a stream of texts(mem_id, ord, section_id, text, ts) and keep their chunks by batch.

    Chunks of a batch go to chunks_path/batch=N: all chunks of the memories in the batch, since a tail
    chunk can grow. latest() reads the newest of each memory. A batch that runs again overwrites its own
    folder, so a failure repeats no text.
    """
    config = config or MemoryConfig()

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{texts_path}/batch={n}")
        all_ = spark.read.schema(batch.schema.add("batch", "long") if "batch" not in batch.columns else batch.schema).parquet(texts_path).where(F.col("batch") <= n).drop("batch")
        touched = all_.join(batch.select("mem_id").distinct(), "mem_id", "left_semi")
        out = ingest.retain(ingest.number(ingest.chunks(ingest.place(touched), config.capacity, config.stride)), config.queue)
        out.write.mode("overwrite").parquet(f"{chunks_path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(chunks: DataFrame) -> DataFrame:
    """The chunks of each memory's newest batch."""
    last = chunks.groupBy("mem_id").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["mem_id", "batch"], "left_semi").drop("batch")
