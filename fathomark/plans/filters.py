"""Filters: what conditions become once the declared types of their paths are known."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum
from typing import Any

from fathomark.errors import UnknownOperatorError
from fathomark.functions.datatypes import TEMPORAL, DataType
from fathomark.functions.schema import FieldDescriptor
from fathomark.plans.conditions import Array, Condition, Function, Group, Lifecycle, Number, Simple

MAX_DEPTH = 256

# The external operators and their names in filters.
OPERATORS: dict[str, str] = {
    "EQUALS": "eq",
    "NOT_EQUAL": "ne",
    "GREATER_THAN": "gt",
    "LESS_THAN": "lt",
    "GREATER_OR_EQUAL": "gte",
    "LESS_OR_EQUAL": "lte",
    "BETWEEN": "between",
    "BETWEEN_INCLUSIVE": "between_inclusive",
    "IS_NULL": "is_null",
    "NOT_NULL": "not_null",
    "CONTAINS": "contains",
    "NOT_CONTAINS": "not_contains",
    "STARTS_WITH": "starts_with",
    "NOT_STARTS_WITH": "not_starts_with",
    "ENDS_WITH": "ends_with",
    "NOT_ENDS_WITH": "not_ends_with",
    "LIKE": "like",
    "MATCHES_PATTERN": "matches",
    "IEQUALS": "ieq",
    "INOT_EQUAL": "ine",
    "ICONTAINS": "icontains",
    "INOT_CONTAINS": "inot_contains",
    "ISTARTS_WITH": "istarts_with",
    "INOT_STARTS_WITH": "inot_starts_with",
    "IENDS_WITH": "iends_with",
    "INOT_ENDS_WITH": "inot_ends_with",
}
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
RANGES = ("between", "between_inclusive")
UNARY = ("is_null", "not_null")
TEMPORAL_META = ("creationDate", "lastUpdateTime")


class Source(Enum):
    DATA = "data"
    META = "meta"


class Coercion(Enum):
    NONE = "none"
    TEMPORAL = "temporal"


@dataclass(frozen=True)
class Filter:
    """A leaf, or and/or over children. The empty operator matches all as a root, nothing as a child."""

    op: str = ""
    path: str = ""
    source: Source = Source.DATA
    value: Any = None
    values: tuple | None = None
    declared: tuple[DataType, ...] = ()
    coercion: Coercion = Coercion.NONE
    children: tuple[Filter, ...] = ()


def operator_names() -> list[str]:
    return sorted(OPERATORS)


def lookup_operator(name: str) -> str:
    if name not in OPERATORS:
        what = repr(name) if name else "missing operator"
        raise UnknownOperatorError(f"{what}; valid: {', '.join(operator_names())}")
    return OPERATORS[name]


def normalise_path(path: str) -> str:
    path = path.strip()
    return path if not path or path.startswith("$") else f"$.{path}"


def plain_path(path: str) -> str:
    """A path without its root; only names, dots and numbers can be pushed down."""
    plain = path[2:] if path.startswith("$.") and len(path) > 2 else path
    if not re.fullmatch(r"[A-Za-z0-9_.\-]*", plain):
        raise ValueError(f"path {path!r} has more than names")
    return plain


def operand_text(value: Any) -> str:
    match value:
        case None:
            return ""
        case bool():
            return "true" if value else "false"
        case str():
            return str(value)
        case dict() | list():
            raise ValueError("an operand must be a scalar")
        case _:
            return str(value)


def _coercion(types: tuple[DataType, ...]) -> Coercion:
    own = [t for t in types if t != DataType.NULL]
    return Coercion.TEMPORAL if own and all(t in TEMPORAL for t in own) else Coercion.NONE


def _bounds(op: str, value: Any) -> tuple | None:
    return tuple(value) if op in RANGES and isinstance(value, list | tuple) and len(value) == 2 else None


def condition_to_filter(condition: Condition | None, fields: Mapping[str, FieldDescriptor] | None = None) -> Filter:
    types = lambda key: fields[key].types if fields and key in fields else ()
    match condition:
        case Simple():
            path, op = plain_path(condition.path), lookup_operator(condition.operator)
            declared = types(normalise_path(condition.path))
            return Filter(op, path, Source.DATA, condition.value, _bounds(op, condition.value), declared, _coercion(declared))
        case Lifecycle():
            name = "transitionForLatestSave" if condition.field == "previousTransition" else condition.field
            op, temporal = lookup_operator(condition.operator), name in TEMPORAL_META
            declared = (DataType.ZONED_DATE_TIME if temporal else DataType.STRING,)
            return Filter(op, name, Source.META, condition.value, _bounds(op, condition.value), declared, _coercion(declared))
        case Group():
            op = "or" if condition.operator.lower() == "or" else "and"
            return Filter(op, children=tuple(condition_to_filter(c, fields) for c in condition.conditions or ()))
        case Array():
            base, key = plain_path(condition.path), normalise_path(condition.path)
            declared = types(key if key.endswith("[*]") else f"{key}[*]")
            leaves = [Filter("eq", f"{base}.{i}", Source.DATA, v, declared=declared) for i, v in enumerate(condition.values or ()) if v is not None]
            return leaves[0] if len(leaves) == 1 else Filter("and", children=tuple(leaves))
        case Function():
            raise ValueError("function conditions have no filter")
        case None:
            raise ValueError("no condition")
    raise ValueError(f"unknown condition: {type(condition).__name__}")


def validate_operators(condition: Condition | None, depth: int = 0) -> None:
    """Raise on an operator that isn't known, or on a tree that is too deep."""
    if condition is None:
        return
    if depth >= MAX_DEPTH:
        raise ValueError(f"conditions nest deeper than {MAX_DEPTH}")
    if isinstance(condition, Simple | Lifecycle):
        lookup_operator(condition.operator)
    elif isinstance(condition, Group):
        for c in condition.conditions or ():
            validate_operators(c, depth + 1)


__all__ = ["OPERATORS", "Coercion", "Filter", "Number", "Source", "condition_to_filter", "lookup_operator", "normalise_path", "operand_text", "operator_names", "plain_path", "validate_operators"]
