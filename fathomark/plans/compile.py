"""A filter as one Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomark.functions.datatypes import DataType as D
from fathomark.functions.decimals import Dec
from fathomark.functions.slots import JsonSlot, Slot, TypedSlot, any_of, let, temporal_millis
from fathomark.plans.expand import Expansion, expand_leaf
from fathomark.plans.filters import TEMPORAL_META, Filter, Source, operand_text

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
# Lifecycle names and the columns of an entity view.
META: dict[str, str] = {
    "entity_id": "id",
    "id": "id",
    "state": "state",
    "version": "version",
    "creationDate": "creation_date",
    "created_at": "creation_date",
    "lastUpdateTime": "last_update",
    "updated_at": "last_update",
    "model_name": "model_name",
    "model_version": "model_version",
    "change_type": "change_type",
    "transaction_id": "transaction_id",
    "transactionId": "transaction_id",
    "transitionForLatestSave": "transition",
}


#: Types of columns that can stand for a scalar of a document.
SCALAR = (T.NumericType, T.StringType, T.BooleanType)


@dataclass
class EntityColumns:
    """Where an entity's parts are: its document, its lifecycle columns with their types, and paths promoted to typed columns."""

    doc: Column | None
    meta: dict[str, T.DataType] = field(default_factory=dict)
    promoted: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)

    def in_document(self, f: Filter) -> bool:
        """Whether a filter looks into the document."""
        if f.op in ("and", "or"):
            return any(map(self.in_document, f.children))
        return f.source is Source.DATA and self.slot(f.path) is None

    def slot(self, path: str) -> TypedSlot | None:
        """The scalar at a path below a promoted column, by names of structs and places in arrays; None where the document has to be asked."""
        if path in self.promoted:
            steps, (name, kind) = [], self.promoted[path]
        else:
            root, *steps = path.split(".")
            if root not in self.promoted:
                return None
            name, kind = self.promoted[root]
        column = F.col(f"`{name}`")
        for step in steps:
            if isinstance(kind, T.StructType) and step in kind.names:
                column, kind = column.getField(step), kind[step].dataType
            elif isinstance(kind, T.ArrayType) and re.fullmatch(r"[0-9]{1,9}", step):
                column, kind = F.get(column, F.lit(int(step))), kind.elementType
            else:
                return None
        return TypedSlot(column, kind) if isinstance(kind, SCALAR) else None

    def typed(self, f: Filter) -> Slot | None:
        if f.source is Source.DATA:
            return self.slot(f.path)
        name = META.get(f.path)
        if name not in self.meta:
            return None
        if f.path in ("created_at", "updated_at"):
            return TypedSlot(F.coalesce(micros(F.col(name), self.meta[name]), F.lit(0).cast("long")), T.LongType())
        return TypedSlot(F.col(name), self.meta[name])


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds of a timestamp, or of a timestamp without zone read as UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)
    return F.unix_micros(column)


def _number_test(slot: Slot, value: Dec, op: str) -> Column:
    """Exactly by decimals where both sides fit them, else by doubles."""
    if isinstance(slot, TypedSlot) and slot.integral and value.scale <= 0 and abs(value.to_scale(0).unscaled) < 1 << 63:
        return COMPARE[op](slot.column, F.lit(value.to_scale(0).unscaled))
    if isinstance(slot, TypedSlot) and slot.double and value.precision() <= 15:
        return COMPARE[op](slot.column, F.lit(value.as_float()))
    near = COMPARE[op](slot.approximate, F.lit(value.as_float()))
    if not value.fits(38, 18):
        return near
    return F.coalesce(COMPARE[op](slot.decimal(), F.lit(Decimal(value.canonical())).cast("decimal(38,18)")), near)


def _folded(text: Column) -> Column:
    """Lower case, letter by letter."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def _text_test(e: Expansion, s: Column) -> Column:
    op, x = e.op, F.lit(e.operand)
    negative = op.startswith(("not_", "inot_")) or op == "ine"
    base = op.removeprefix("not_") if op.startswith("not_") else "i" + op.removeprefix("inot_") if op.startswith("inot_") else "ieq" if op == "ine" else op
    match base:
        case "like" | "matches":
            return s.rlike(rf"(?d)\A(?:{e.pattern})\z") if e.pattern is not None else F.lit(False)
        case "contains":
            test = s.contains(x)
        case "starts_with":
            test = s.startswith(x)
        case "ends_with":
            test = s.endswith(x)
        case "ieq":
            test = s.rlike("(?iu)\\A" + ("\\Q" + e.operand.replace("\\E", "\\E\\\\E\\Q") + "\\E" if e.operand else "") + "\\z")
        case "icontains":
            test = _folded(s).contains(_folded(x))
        case "istarts_with":
            test = _folded(s).startswith(_folded(x))
        case _:
            test = _folded(s).endswith(_folded(x))
    return ~test if negative else test


def _uuid(text: Column) -> Column:
    """The 32 digits of a UUID in any of its notations, else null."""
    bare = F.regexp_replace(F.lower(text), r"^urn:uuid:|^\{|\}$", "")
    return F.when(bare.rlike(r"\A(?:[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\z"), F.regexp_replace(bare, "-", ""))


def _compare(e: Expansion, slot: Slot) -> Column:
    tests = []
    for n in e.numeric:
        gate = slot.widens_to(n.type)
        tests.append(gate if n.value is None else _number_test(slot, n.value, n.op) & gate)  # the cheaper test goes first
    for t, at, op in e.temporal:
        tests.append(COMPARE[op](temporal_millis(slot.text, t), F.lit(at)))
    for t, v in e.others:
        if t == D.STRING:
            tests.append(COMPARE[e.op](slot.text, F.lit(v)))
        elif t == D.CHARACTER:
            tests.append((F.length(slot.text) == 1) & COMPARE[e.op](slot.text, F.lit(v)))
        elif e.op in ("eq", "ne"):
            if t == D.BOOLEAN:
                tests.append(COMPARE[e.op](slot.boolean, F.lit(v)))
            else:
                tests.append(COMPARE[e.op](_uuid(slot.text), F.lit(str(v).replace("-", ""))))
    return any_of(tests)


def _range(e: Expansion, slot: Slot) -> Column:
    low, high = ("gte", "lte") if e.op == "between_inclusive" else ("gt", "lt")
    tests = []
    if e.numeric_range:
        a, b, types = e.numeric_range
        gate = any_of([slot.widens_to(t) for t in types])
        tests.append(_number_test(slot, a, low) & _number_test(slot, b, high) & gate)
    for t, a, b in e.temporal_ranges:
        at = temporal_millis(slot.text, t)
        tests.append(COMPARE[low](at, F.lit(a)) & COMPARE[high](at, F.lit(b)))
    if e.text_range:
        tests.append(COMPARE[low](slot.text, F.lit(e.text_range[0])) & COMPARE[high](slot.text, F.lit(e.text_range[1])))
    return any_of(tests)


def _meta_instant(e: Expansion, column: Column, kind: T.DataType) -> Column:
    """A comparison with a lifecycle instant, by milliseconds."""
    at = F.floor(micros(column, kind) / 1000) if e.kind == "range" or any(op in ("eq", "ne") for _, _, op in e.temporal) else None
    tests = []
    for _, ms, op in e.temporal:
        if at is not None:
            tests.append(COMPARE[op](at, F.lit(ms)))
            continue
        # whole milliseconds turn into bounds on the column itself, which a scan can use
        edge = ms + 1 if op in ("gt", "lte") else ms
        instant = F.timestamp_add("MICROSECOND", F.lit(edge * 1000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) if isinstance(kind, T.TimestampNTZType) else F.timestamp_micros(F.lit(edge * 1000))
        tests.append(column >= instant if op in ("gt", "gte") else column < instant)
    low, high = ("gte", "lte") if e.op == "between_inclusive" else ("gt", "lt")
    tests += [COMPARE[low](at, F.lit(a)) & COMPARE[high](at, F.lit(b)) for _, a, b in e.temporal_ranges]
    return any_of(tests)


def _leaf(f: Filter, where: EntityColumns) -> Column:
    try:
        e = expand_leaf(f.op, operand_text(f.value) if f.values is None else "", None if f.values is None else [operand_text(v) for v in f.values], list(f.declared))
    except ValueError:
        return F.lit(False)
    if e.void:
        return F.lit(False)
    if where.in_document(f):
        return JsonSlot.bound(where.doc, f.path, lambda slot: _test(e, slot)) if where.doc is not None else F.lit(f.op == "is_null")
    slot = where.typed(f)
    if slot is None:
        return F.lit(f.op == "is_null")
    if f.source is Source.META and f.path in TEMPORAL_META and e.kind != "unary":
        if e.kind == "text":
            raise ValueError(f"{f.op} is no operator for {f.path}")
        name = META[f.path]
        return _meta_instant(e, F.col(name), where.meta[name])
    return _test(e, slot)


def _test(e: Expansion, slot: Slot) -> Column:
    match e.kind:
        case "unary":
            return slot.present if e.op == "not_null" else ~F.coalesce(slot.present, F.lit(False))
        case "text":
            return _text_test(e, slot.text)
        case "compare":
            return _compare(e, slot)
    return _range(e, slot)


def compile_filter(f: Filter, where: EntityColumns) -> Column:
    """True exactly for the entities that match; elsewhere false or null. A root without operator matches all.

    What looks into the document shares one parse of it; the rest stays bare, for scans to use.
    """
    if not f.op:
        return F.lit(True)
    if not where.in_document(f) or where.doc is None:
        return _compiled(f, where)
    if f.op == "and":
        inside = replace(f, children=tuple(c for c in f.children if where.in_document(c)))
        outside = replace(f, children=tuple(c for c in f.children if not where.in_document(c)))
        return _compiled(outside, where) & let(where.doc, lambda d: _compiled(inside, replace(where, doc=d)))
    return let(where.doc, lambda d: _compiled(f, replace(where, doc=d)))


def _compiled(f: Filter, where: EntityColumns) -> Column:
    if f.op == "and":
        return reduce(lambda a, b: a & b, (_compiled(c, where) for c in f.children)) if f.children else F.lit(True)
    if f.op == "or":
        return any_of([_compiled(c, where) for c in f.children])
    return _leaf(f, where)
