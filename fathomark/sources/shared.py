"""The folder that driver and executors share, for what is computed once and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; only a local master gets one of its own where neither is set."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fathomark-"))
    return sc.getCheckpointDir().rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Scratch paths that are made inside go at the end; whatever is read from them has to be done by then."""
    token = _made.set([])
    try:
        yield
    finally:
        paths = _made.get() or []
        _made.reset(token)
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, and still there when an executor is lost."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
