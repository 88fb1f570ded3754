"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a table here and reading it back. Unlike a local
checkpoint the rows survive the loss of any executor, and unlike a cached table Spark knows their
size, so it can pick its join strategy from facts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session may fall back to a temporary folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_ledgerloom_scratch", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext._ledgerloom_scratch = made
    return made


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Scratch tables made inside go when the block ends, instead of with the session. What is returned from the block must
    have been written or counted by then."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as a scratch table and return the table read back; it goes when its ``scope`` or the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, fs = _filesystem(spark, path)
    fs.deleteOnExit(target)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch_path = path
    if _scopes:
        _scopes[-1].append(kept)
    return kept


def drop(*frames: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            target, fs = _filesystem(df.sparkSession, path)
            fs.delete(target, True)
