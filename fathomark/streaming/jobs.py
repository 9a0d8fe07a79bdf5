"""Asynchronous searches: jobs whose result ids are a table, read by pages; and filters over streams."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from contextvars import copy_context
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomark.errors import NotFoundError
from fathomark.operators.search import async_page, order_columns, search
from fathomark.plans.compile import compile_filter
from fathomark.sources.context import must_user
from fathomark.sources.entities import EntityView
from fathomark.sources.log import LogTable
from fathomark.sources.shared import clearing, written
from fathomark.sources.store import EntityStore, ModelRef, time_uuid

RUNNING, SUCCESSFUL, FAILED, CANCELLED = "RUNNING", "SUCCESSFUL", "FAILED", "CANCELLED"


def numbered(view: EntityView, found: DataFrame, order: tuple = ()) -> DataFrame:
    """Ids with their place in the order. Range partitions are sorted each by itself and offset by the sizes of those before, so no task holds all rows.

    The sorted ids are written once: bounds of ranges are drawn anew whenever a plan runs, and places must come from the same ones as sizes.
    """
    keys = order_columns(view, order)
    rows = found.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    rows = written(rows, "order")
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("_before", before), "_p").select((F.col("_m") - F.col("_first") + F.col("_before")).alias("pos"), "id")


class JobStore:
    """Jobs and their results as tables. Nothing runs here: whoever creates a job executes it, and reports by save_results and update_status."""

    #: Whether a created job runs by itself; if not, the caller executes it.
    self_executing = False

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.table = LogTable(spark, f"{path}/jobs", "id string, tenant_id string, status string, model_name string, model_version string, condition string, point_in_time timestamp, options string, error string, result_count long, calc_time_ms long, create_time timestamp, finish_time timestamp, removed boolean")
        self.results = LogTable(spark, f"{path}/job_results", "job_id string, pos long, entity_id string", partition_by=("job_id",))
        self.lock = threading.RLock()

    def _put(self, job: Mapping[str, Any], **values: Any) -> None:
        self.table.append([{**job, **values}])

    def job(self, job_id: str) -> dict:
        row = self.table.latest(["id"]).where((F.col("id") == job_id) & (F.col("tenant_id") == must_user().tenant) & ~F.col("removed")).first()
        if row is None:
            raise NotFoundError(job_id)
        return {k: v for k, v in row.asDict().items() if not k.startswith("_")}

    def create_job(self, model: ModelRef, condition: str, *, at: datetime | None = None, options: str | None = None) -> str:
        """A running job, of the entities as they are, or as they were at a time; options are kept as they come."""
        job_id = time_uuid()
        self._put({"id": job_id, "tenant_id": must_user().tenant, "status": RUNNING, "model_name": model.name, "model_version": model.version, "condition": condition, "point_in_time": at, "options": options, "create_time": datetime.now(timezone.utc), "removed": False})
        return job_id

    def update_status(self, job_id: str, status: str, *, result_count: int = 0, error: str | None = None, finish_time: datetime | None = None, calc_time_ms: int = 0) -> None:
        with self.lock:
            self._put(self.job(job_id), status=status, result_count=result_count, error=error, finish_time=finish_time or datetime.now(timezone.utc), calc_time_ms=calc_time_ms)

    def save_results(self, job_id: str, ids: DataFrame | Iterable[str]) -> None:
        """ids: in order, or a table of pos and entity_id."""
        self.job(job_id)
        if not isinstance(ids, DataFrame):
            self.results.append([{"job_id": job_id, "pos": pos, "entity_id": i} for pos, i in enumerate(ids)])
        else:
            self.results.append(ids.select(F.lit(job_id).alias("job_id"), "pos", "entity_id"))

    def cancel(self, job_id: str) -> bool:
        """Whether it was still running."""
        with self.lock:
            job = self.job(job_id)
            if job["status"] != RUNNING:
                return False
            self._put(job, status=CANCELLED, finish_time=datetime.now(timezone.utc))
        return True

    def page(self, job_id: str, offset: int, limit: int) -> tuple[list[str], int]:
        job, mine = self.job(job_id), self.results.read()
        total = job["result_count"] if job["status"] == SUCCESSFUL else mine.where(F.col("job_id") == job_id).count()
        return [r.entity_id for r in async_page(mine, job_id, offset, limit).collect()], total

    def _remove(self, jobs: list[dict]) -> None:
        if jobs:
            self.table.append([j | {"removed": True} for j in jobs])
            self.results.forget("job_id", [j["id"] for j in jobs])

    def delete(self, job_id: str) -> None:
        """A job goes with its results, whatever its status."""
        with self.lock:
            self._remove([self.job(job_id)])

    def reap(self, before: datetime) -> int:
        """Ended jobs that were finished before a time go, with their results, in one commit."""
        old = self.table.latest(["id"]).where((~F.col("removed")) & (F.col("status") != RUNNING) & (F.col("finish_time") < F.lit(before))).drop("_commit", "_pos").collect()
        self._remove([r.asDict() for r in old])
        return len(old)


class SearchJobs(JobStore):
    """Jobs that run as they are created, each in its own Spark job group."""

    self_executing = True

    def __init__(self, spark: SparkSession, path: str, store: EntityStore) -> None:
        super().__init__(spark, path)
        self.store, self.pool = store, ThreadPoolExecutor(4)
        self.running: dict[str, Future] = {}

    def create(self, model: ModelRef, condition: str, *, fields: Mapping | None = None, order: tuple = (), at: datetime | None = None, options: str | None = None) -> str:
        job_id = self.create_job(model, condition, at=at, options=options)
        view = self.store.view(model, fields, at)

        def run() -> None:
            began = time.monotonic()
            self.spark.sparkContext.setJobGroup(job_id, "search", True)
            try:
                with clearing(self.spark):
                    self.save_results(job_id, numbered(view, search(view, condition, order), order).withColumnRenamed("id", "entity_id"))
                n = self.results.read().where(F.col("job_id") == job_id).count()
                done = {"status": SUCCESSFUL, "result_count": n}
            except Exception as e:
                done = {"status": FAILED, "error": str(e)[:2000]}
            with self.lock:
                try:
                    ended = self.job(job_id)["status"] != RUNNING
                except NotFoundError:
                    # deleted while it ran: what it saved since goes too
                    self.results.forget("job_id", [job_id])
                    return
                if not ended:
                    self.update_status(job_id, **done, calc_time_ms=int((time.monotonic() - began) * 1000))

        self.running[job_id] = self.pool.submit(copy_context().run, run)
        return job_id

    def wait(self, job_id: str, timeout: float = 300) -> dict:
        if job_id in self.running:
            self.running[job_id].result(timeout)
        return self.job(job_id)

    def cancel(self, job_id: str) -> bool:
        cancelled = super().cancel(job_id)
        if cancelled:
            self.spark.sparkContext.cancelJobGroup(job_id)
        return cancelled

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


def matching_stream(stream: DataFrame, view: EntityView, condition: str) -> DataFrame:
    """The rows of a stream of entities that match; nothing is kept between batches."""
    own = view.over(stream)
    return stream.where(compile_filter(own.filter_of(condition), own.columns()))
