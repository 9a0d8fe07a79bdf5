"""Scheduled tasks: due ones, late ones, and what an entity's change leaves of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.sources.log import LogTable

FIRE_TRANSITION = "fire-transition"


@dataclass
class ScheduledTask:
    id: str
    tenant_id: str
    scheduled_time: int
    type: str = FIRE_TRANSITION
    timeout_ms: int | None = None
    redispatch_after: int | None = None
    entity_id: str = ""
    model_name: str = ""
    model_version: int = 0
    transition: str = ""
    source_state: str = ""
    armed_at: int = 0
    attempt_count: int = 0
    armed_by_id: str = ""
    armed_by_kind: str = ""


_KINDS = {"scheduled_time": "long", "timeout_ms": "long", "redispatch_after": "long", "armed_at": "long", "model_version": "int", "attempt_count": "int"}


def due(tasks: DataFrame, now: Column | int) -> DataFrame:
    """Tasks whose time has come and that are not held back, of all tenants, earliest first."""
    now = F.lit(now) if isinstance(now, int) else now
    ready = (F.col("scheduled_time") <= now) & (F.col("redispatch_after").isNull() | (F.col("redispatch_after") <= now))
    return tasks.where(ready).orderBy("scheduled_time", "id")


def lateness(now: Column | int) -> Column:
    """FIRE, unless a task is later than its timeout allows."""
    late = (F.lit(now) if isinstance(now, int) else now) - F.col("scheduled_time")
    return F.when(F.col("timeout_ms").isNull() | (late <= F.col("timeout_ms")), "FIRE").otherwise("EXPIRE")


def reconciled(tasks: DataFrame, entity: Column, state: Column, arm: DataFrame | None = None, cancel: DataFrame | None = None) -> DataFrame:
    """What is left of tasks once an entity is in a state: its tasks of other states and the cancelled ones go, the armed ones come or replace."""
    left = tasks.where(~((F.col("entity_id") == entity) & (F.col("source_state") != state)))
    for gone in (cancel, arm):
        if gone is not None:
            left = left.join(gone.select("id"), "id", "left_anti")
    return left if arm is None else left.unionByName(arm)


class ScheduledTasks:
    def __init__(self, spark: SparkSession, path: str) -> None:
        schema = ", ".join(f"{f.name} {_KINDS.get(f.name, 'string')}" for f in fields(ScheduledTask))
        self.table = LogTable(spark, f"{path}/tasks", f"{schema}, removed boolean")

    def tasks(self) -> DataFrame:
        return self.table.latest(["id"]).where("not removed").drop("removed", "_commit", "_pos")

    def _put(self, rows: Iterable[Mapping[str, Any]]) -> None:
        rows = [{"removed": False, **r} for r in rows]
        if rows:
            self.table.append(rows)

    def upsert(self, *tasks: ScheduledTask) -> None:
        self._put(map(asdict, tasks))

    def _find(self, ids: list[str]) -> dict[str, dict]:
        return {r.id: r.asDict() for r in self.tasks().where(F.col("id").isin(ids)).collect()} if ids else {}

    def get(self, task_id: str) -> ScheduledTask | None:
        row = self._find([task_id]).get(task_id)
        return ScheduledTask(**row) if row else None

    def scan_due(self, now: int, limit: int) -> list[ScheduledTask]:
        return [ScheduledTask(**r.asDict()) for r in due(self.tasks(), now).limit(limit).select(*(f.name for f in fields(ScheduledTask))).collect()]

    def mark_redispatch(self, task_id: str, after: int) -> None:
        row = self._find([task_id]).get(task_id)
        if row:
            self._put([row | {"redispatch_after": after, "attempt_count": row["attempt_count"] + 1}])

    def delete(self, task_id: str) -> bool:
        row = self._find([task_id]).get(task_id)
        if row:
            self._put([row | {"removed": True}])
        return row is not None

    def reconcile(self, tenant: str, entity_id: str, state: str, arm: Iterable[ScheduledTask] = (), cancel: Iterable[str] = ()) -> list[ScheduledTask]:
        """The tasks that went because their state is no longer the entity's."""
        arm, cancel = list(arm), list(cancel)
        kept = {t.id for t in arm}
        mine = (F.col("tenant_id") == tenant) & (F.col("entity_id") == entity_id) & (F.col("source_state") != state)
        stale = [r.asDict() for r in self.tasks().where(mine).orderBy("id").collect() if r.id not in kept]
        dropped = [r for i, r in self._find([i for i in cancel if i not in kept]).items() if i not in {s["id"] for s in stale} and r["tenant_id"] == tenant]
        self._put([asdict(t) for t in arm] + [r | {"removed": True} for r in stale + dropped])
        return [ScheduledTask(**r) for r in stale]
