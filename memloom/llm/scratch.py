"""Tables written between the steps of an operator, in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. A written table cuts the lineage, so a lost
executor costs the tasks of one step. The application's tables go when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/memloom-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_watched: set[str] = set()


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return it reread."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if base not in _watched:
        _watched.add(base)
        atexit.register(_clean, spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # the written table replaces the shuffles that made it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote, once nothing reads it any more."""
    _remove(df.sparkSession, df._scratch_path)


def _clean(spark: SparkSession, base: str) -> None:
    try:
        _remove(spark, base)
    except Exception:  # the session may have ended first
        pass


def parts(spark: SparkSession, n_bytes: int, per_part: int = 16 << 20) -> int:
    """How many partitions n_bytes need: never below the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_part))
