"""Sinks: overwrite and append, scored tables that thresholds can be cut from again, artifacts made once."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def overwrite(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("append").format(kind).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first if no complete one is there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def when_there(spark: SparkSession, path: str, poll: float = 0.5, timeout: float = 3600.0) -> DataFrame:
    """The table at path, as soon as a complete one is there: a stage that begins when another job has ended.  A table that
    is still being written is not complete; none in time is an error."""
    until = time.monotonic() + timeout
    while not exists(spark, path):
        if time.monotonic() >= until:
            raise TimeoutError(f"no complete table at {path}")
        time.sleep(poll)
    return spark.read.parquet(path)


def gate_view(scored: DataFrame, ok) -> DataFrame:
    """The rows of a scored table that pass; the table keeps the others, so that a gate can be cut again."""
    return scored.where(ok)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may have one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_kept: set = set()


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: what it holds stays the same when an executor is lost.  An
    application's tables go when its driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/kept/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(_clear, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clear(folder: str) -> None:
    if (sc := SparkContext._active_spark_context) is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
