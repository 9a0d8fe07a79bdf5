"""What the operators of this subpackage share: tables, the shared folder, packing, blobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.sources.shared import clearing, remove, scratch, written

__all__ = ["FAN_IN", "SLICES", "clearing", "remove", "scratch", "session_batches", "slices_summed", "small_batches", "table", "unvarint", "varint", "written"]

#: Parts of a table of counts that are summed apart, and tasks whose parts one task sums at first.
SLICES = 64
FAN_IN = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of no more rows inside, for jobs that run there; afterwards the session's setting is what it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def session_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For applications (the queries and the pipeline, not the operators): Arrow batches of no more rows in this session, as its tables hold long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def varint(values: np.ndarray) -> bytes:
    """Unsigned integers, seven bits a byte, low bits first."""
    v = np.asarray(values, dtype=np.uint64)
    if not len(v):
        return b""
    parts = [(v >> np.uint64(7 * k)) for k in range(10)]
    length = 1 + sum((p > 0).astype(np.int64) for p in parts[1:])
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), dtype=np.uint8)
    for k in range(int(length.max())):
        has = length > k
        out[start[has] + k] = (parts[k][has] & np.uint64(127)).astype(np.uint8) | ((length[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    last = np.flatnonzero(b < 128)
    start = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from fathomark.llm.packing import squeeze, unsqueeze

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + unsqueeze(data, "<i8")
    for part, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([squeeze(x, "<i8")], pa.binary())], names=["part", "kind", "data"])


def slices_summed(blobs: DataFrame, slices: int, length: int, tasks: int) -> np.ndarray:
    """The sum of tables of counts, of which each task gives all slices (part; data as packed by squeeze): by a tree of tasks, of which none sums more than FAN_IN tables or as many partial sums as there are of those."""
    from fathomark.llm.packing import unsqueeze

    schema = "part int, kind int, data binary"
    groups = tasks // FAN_IN
    if groups > 1:
        group = F.pmod(F.spark_partition_id(), F.lit(groups))
        blobs = blobs.withColumn("kind", group).repartition(groups * slices, "part", "kind").mapInArrow(_sum_slices, schema)
    out = np.zeros((slices, length // SLICES), dtype=np.int64)
    for r in blobs.repartitionById(slices, "part").mapInArrow(_sum_slices, schema).collect():
        out[r.part] = unsqueeze(r.data, "<i8")
    return out.reshape(-1)
