"""The folder that all executors share, tables written to it, and the size of what goes to Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to Python. The default is a number of rows, which for long texts is no bound at all.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to BATCH_BYTES, unless it is lower."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_within: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a temporary folder for local runs; refused on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{_within.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables stored within are deleted at the end: for work whose result has been written elsewhere by then."""
    path = fresh_path(spark, "scratch")
    outer = _within.set(path)
    try:
        yield path
    finally:
        _within.reset(outer)
        remove(spark, path)


def stored(df: DataFrame, what: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder, a folder for each value of by, and read it again: what comes after it scans
    the result instead of computing it once more, also where an executor is lost."""
    path = fresh_path(df.sparkSession, what)
    writer = df.write.partitionBy(by) if by else df.write
    (writer.option("compression", codec) if codec else writer).parquet(path)
    schema = df.schema
    if by:
        schema = type(schema)([*(f for f in schema if f.name != by), *(f for f in schema if f.name == by)])
    return df.sparkSession.read.schema(schema).parquet(path)
