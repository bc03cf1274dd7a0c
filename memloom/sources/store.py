"""A memory on disk: its tables as Parquet or JSON, and a manifest that must fit on loading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..config import MemoryConfig

FORMATS = ("parquet", "json", "orc")
TABLES = ("texts", "chunks", "vectors", "messages", "agent_state")


class IncompatibleMemory(ValueError):
    """The stored memory was built with other settings."""


def _manifest(config: MemoryConfig, embedder: str, tokenizer: str) -> dict:
    return {"capacity": config.capacity, "overlap": config.overlap, "tokenizer": tokenizer, "embedder": embedder}


def save(path: str, tables: dict[str, DataFrame], config: MemoryConfig, embedder: str = "hashed", tokenizer: str = "words", kind: str = "parquet", state: dict | None = None) -> None:
    """Write tables and manifest below path, in place of what is there. state is free JSON, such as an agent's variant and profile."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")
    manifest = _manifest(config, embedder, tokenizer) | {"kind": kind, "state": state or {}, "tables": {n: df.schema.json() for n, df in tables.items()}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, config: MemoryConfig, embedder: str = "hashed", tokenizer: str = "words") -> tuple[dict[str, DataFrame], dict]:
    """Tables and state. Raises IncompatibleMemory where capacity, overlap, tokenizer or embedder differ."""
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    for k, v in _manifest(config, embedder, tokenizer).items():
        if manifest[k] != v:
            raise IncompatibleMemory(f"{k} is {manifest[k]} in the store, {v} here")
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(s))).format(manifest["kind"]).load(f"{path}/{n}") for n, s in manifest["tables"].items()}
    return tables, manifest["state"]
