"""Counts and grouped statistics over entity views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fathomark.errors import AggregationNotPushdownableError, GroupCardinalityExceededError
from fathomark.functions.slots import JsonSlot, Slot, TypedSlot
from fathomark.operators.search import filtered
from fathomark.plans.conditions import Condition
from fathomark.plans.filters import Filter, plain_path
from fathomark.sources.entities import EntityView

STATE = "state"
# The aggregates by name; deviation is the sample's.
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev_samp}


@dataclass(frozen=True)
class GroupExpr:
    """STATE, or a path into the document."""

    path: str = STATE
    is_state: bool = False


@dataclass(frozen=True)
class AggregateExpr:
    op: str
    field: str
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias.strip() or f"{self.op}_{self.field.removeprefix('$.')}"


def _slot(view: EntityView, path: str) -> Slot:
    where, path = view.columns(), plain_path(path)
    return where.slot(path) or JsonSlot.of(where.doc, path)


def _key(view: EntityView, g: GroupExpr) -> Column:
    """A scalar as text; what is missing, null or no scalar shares one null."""
    if g.is_state:
        return F.col("state")
    slot = _slot(view, g.path)
    if isinstance(slot, TypedSlot):
        return slot.any_text
    return F.when(slot.present & ~slot.kind.startswith("OBJECT") & ~slot.kind.startswith("ARRAY"), slot.any_text)


def _decline_unless_plain(group_by: Sequence[GroupExpr], aggregations: Sequence[AggregateExpr]) -> None:
    for a in aggregations:
        if a.op not in AGGREGATES:
            raise AggregationNotPushdownableError(f"no aggregate {a.op!r}; there are {', '.join(AGGREGATES)}")
    for path in (*(g.path for g in group_by if not g.is_state), *(a.field for a in aggregations)):
        try:
            plain_path(path)
        except ValueError as e:
            raise AggregationNotPushdownableError(str(e)) from e


def grouped(view: EntityView, group_by: Sequence[GroupExpr], condition: Condition | Filter | str | None = None, aggregations: Sequence[AggregateExpr] = ()) -> DataFrame:
    """A row for each bucket: its keys, count, and aggregates of the numbers at each field (null where there are none).

    Declines, by AggregationNotPushdownableError, what has no plan: unknown aggregates, and paths that fan out ("$.items[*].n"). The caller can go through ``iterate`` then.
    """
    _decline_unless_plain(group_by, aggregations)
    rows = filtered(view, condition)
    keys = [_key(view, g).alias("state" if g.is_state else plain_path(g.path)) for g in group_by]
    names = {f: f"_s{i}" for i, f in enumerate(dict.fromkeys(a.field for a in aggregations))}
    rows = rows.select(*keys, *(_slot(view, f).approximate.alias(n) for f, n in names.items()))
    own = [f"`{'state' if g.is_state else plain_path(g.path)}`" for g in group_by]
    made = [AGGREGATES[a.op](names[a.field]).alias(a.name) for a in aggregations]
    return rows.groupBy(*own).agg(F.count(F.lit(1)).alias("count"), *made)


def grouped_bounded(view: EntityView, group_by: Sequence[GroupExpr], max_buckets: int, condition: Condition | Filter | str | None = None, aggregations: Sequence[AggregateExpr] = ()) -> list[Row]:
    """All buckets, or an error and none if there are more than max_buckets."""
    if max_buckets <= 0:
        raise ValueError("max_buckets must be positive")
    found = grouped(view, group_by, condition, aggregations).limit(max_buckets + 1).collect()
    if len(found) > max_buckets:
        raise GroupCardinalityExceededError(f"more than {max_buckets} groups")
    return found


def count(view: EntityView) -> int:
    return view.df.count()


def count_by_state(view: EntityView, states: Sequence[str] | None = None) -> DataFrame:
    """Entities by state; of all states for None, of none for an empty list."""
    rows = view.df if states is None else view.df.where(F.col("state").isin(*states) if states else F.lit(False))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("count"))
