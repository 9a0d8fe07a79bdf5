"""Search over entity views: filter, order, bounded or failing limits, point-in-time reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from enum import Enum

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fathomark.errors import ScanBudgetExhaustedError, SearchResultLimitExceededError
from fathomark.functions.datatypes import FRACTIONAL, TEMPORAL, WHOLE
from fathomark.functions.datatypes import DataType as D
from fathomark.functions.slots import JsonSlot
from fathomark.plans.compile import compile_filter, micros
from fathomark.plans.conditions import Condition
from fathomark.plans.filters import Filter, Source, plain_path
from fathomark.sources.entities import EntityView


class OrderKind(Enum):
    TEXT = "text"
    NUMERIC = "numeric"
    BOOL = "bool"
    TEMPORAL = "temporal"


@dataclass(frozen=True)
class OrderSpec:
    path: str
    source: Source = Source.DATA
    desc: bool = False
    kind: OrderKind = OrderKind.TEXT


# The lifecycle names that results can be ordered by, their columns and kinds.
META_ORDER: dict[str, tuple[str, OrderKind]] = {
    "state": ("state", OrderKind.TEXT),
    "creationDate": ("creation_date", OrderKind.TEMPORAL),
    "lastUpdateTime": ("last_update", OrderKind.TEMPORAL),
    "transitionForLatestSave": ("transition", OrderKind.TEXT),
    "transactionId": ("transaction_id", OrderKind.TEXT),
    "id": ("id", OrderKind.TEXT),
}


def meta_field_names() -> list[str]:
    return sorted(META_ORDER)


def resolve_meta_field(name: str) -> OrderSpec:
    if name not in META_ORDER:
        raise ValueError(f"{name!r} is no lifecycle field; valid: {', '.join(meta_field_names())}")
    return OrderSpec(name, Source.META, kind=META_ORDER[name][1])


def classify_order(types: Sequence[D], fold_temporal: bool = False) -> OrderKind:
    """The one kind of order that all declared types have; nullability doesn't count."""
    kinds = set()
    for t in types:
        if t == D.NULL:
            continue
        if t in WHOLE or t in FRACTIONAL:
            kinds.add(OrderKind.NUMERIC)
        elif t in TEMPORAL:
            kinds.add(OrderKind.TEXT if fold_temporal else OrderKind.TEMPORAL)
        elif t == D.BOOLEAN:
            kinds.add(OrderKind.BOOL)
        elif t == D.BYTE_ARRAY:
            raise ValueError("bytes have no order")
        else:
            kinds.add(OrderKind.TEXT)
    if len(kinds) != 1:
        raise ValueError(f"no single order for {[t.name for t in types]}")
    return kinds.pop()


def filtered(view: EntityView, condition: Condition | Filter | str | None) -> DataFrame:
    return view.df.where(compile_filter(view.filter_of(condition), view.columns()))


def _order_key(view: EntityView, spec: OrderSpec) -> Column:
    where = view.columns()
    if spec.source is Source.META:
        name = META_ORDER[spec.path][0]
        if name not in where.meta:
            return F.lit(None).cast("string")
        if META_ORDER[spec.path][1] is OrderKind.TEMPORAL:
            # whole milliseconds towards zero
            ms = micros(F.col(name), where.meta[name]) / 1000
            return F.when(ms < 0, F.ceil(ms)).otherwise(F.floor(ms))
        return F.when(F.col(name) != "", F.col(name))
    path = plain_path(spec.path)
    slot = where.slot(path) or JsonSlot.of(where.doc, path)
    match spec.kind:
        case OrderKind.NUMERIC:
            return F.when(slot.present, F.coalesce(slot.approximate, F.when(F.coalesce(slot.boolean, F.lit(False)), 1.0), slot.text.try_cast("double"), F.lit(0.0)))
        case OrderKind.BOOL:
            return F.when(slot.present, F.coalesce(slot.boolean, F.lower(slot.text).isin("true", "t", "1"), slot.approximate != 0, F.lit(False)))
        case OrderKind.TEMPORAL:
            return F.when(slot.present, F.coalesce(slot.approximate, F.lit(0.0)))
    return F.when(slot.present, slot.any_text)


def order_columns(view: EntityView, specs: Sequence[OrderSpec]) -> list[Column]:
    """What is missing goes last either way; ids decide last."""
    keys = [_order_key(view, s) for s in specs]
    return [k.desc_nulls_last() if s.desc else k.asc_nulls_last() for k, s in zip(keys, specs, strict=True)] + [F.col("id").asc()]


def search(view: EntityView, condition: Condition | Filter | str | None = None, order: Sequence[OrderSpec] = ()) -> DataFrame:
    """Matching entities in order (by id, if none is given), without a bound."""
    return filtered(view, condition).orderBy(*order_columns(view, order))


def search_bounded(view: EntityView, condition: Condition | Filter | str | None, limit: int, order: Sequence[OrderSpec] = ()) -> list[Row]:
    """Matching entities, or an error and none if there are more than limit. No positive limit is no bound."""
    rows = search(view, condition, order)
    found = (rows.limit(limit + 1) if limit > 0 else rows).collect()
    if 0 < limit < len(found):
        raise SearchResultLimitExceededError(f"more than {limit} matches")
    return found


def merged(committed: DataFrame, staged: DataFrame, deleted: DataFrame) -> DataFrame:
    """Committed entities with a transaction's own changes over them: staged ones replace, deleted ones go."""
    gone = deleted.select("id").unionByName(staged.select("id"))
    return committed.join(gone, "id", "left_anti").unionByName(staged, allowMissingColumns=True)


def merge_bounded(view: EntityView, staged: DataFrame, deleted: DataFrame, condition: Condition | Filter | str | None, limit: int, order: Sequence[OrderSpec] = ()) -> list[Row]:
    """Matches among committed entities with a transaction's changes over them, in order, or an error if there are more than limit.

    Each task keeps the first limit + 1 of its rows, and so does the driver, whatever the table holds.
    """
    return search_bounded(view.over(merged(view.df, staged, deleted)), condition, limit, order)


def iterate(view: EntityView, condition: Condition | Filter | str | None = None, budget: int | None = None) -> Iterator[Row]:
    """Matching entities one by one, a partition at a time. budget: how many may be looked at."""
    if budget is not None and view.df.limit(budget + 1).count() > budget:
        raise ScanBudgetExhaustedError(f"more than {budget} entities to look at")
    yield from filtered(view, condition).toLocalIterator()


def as_of(versions: DataFrame, at: datetime | Column | None = None, *, keep_deleted: bool = False) -> DataFrame:
    """The latest version of each entity, of those written at that time or before; without tombstones.

    The newest is found by an aggregate that combines before the shuffle, not by a sorted window.
    """
    if at is not None:
        versions = versions.where(F.col("timestamp") <= (at if isinstance(at, Column) else F.lit(at)))
    keys = [c for c in ("tenant_id", "model_name", "model_version", "id") if c in versions.columns]
    rest = [c for c in versions.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version", "timestamp")).alias("_last"))
    rows = last.select(*keys, "_last.*")
    return rows if keep_deleted else rows.where(~F.col("deleted"))


def history(versions: DataFrame, entity_id: str) -> DataFrame:
    return versions.where(F.col("id") == entity_id).orderBy("timestamp", "version")


def async_page(results: DataFrame, job_id: str, offset: int, limit: int) -> DataFrame:
    return results.where((F.col("job_id") == job_id) & (F.col("pos") >= offset) & (F.col("pos") < offset + limit)).orderBy("pos")
