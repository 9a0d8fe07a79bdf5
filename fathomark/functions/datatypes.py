"""The declared types of document paths: families, widening, sets."""

from __future__ import annotations

from collections.abc import Iterable
from enum import IntEnum


class DataType(IntEnum):
    """In the order in which a set of types is listed."""

    INTEGER = 0
    LONG = 1
    BIG_INTEGER = 2
    UNBOUND_INTEGER = 3
    DOUBLE = 4
    BIG_DECIMAL = 5
    UNBOUND_DECIMAL = 6
    STRING = 7
    CHARACTER = 8
    LOCAL_DATE = 9
    LOCAL_DATE_TIME = 10
    LOCAL_TIME = 11
    ZONED_DATE_TIME = 12
    YEAR = 13
    YEAR_MONTH = 14
    UUID_TYPE = 15
    TIME_UUID_TYPE = 16
    BYTE_ARRAY = 17
    BOOLEAN = 18
    NULL = 19


D = DataType
WHOLE = (D.INTEGER, D.LONG, D.BIG_INTEGER, D.UNBOUND_INTEGER)
FRACTIONAL = (D.DOUBLE, D.BIG_DECIMAL, D.UNBOUND_DECIMAL)
TEMPORAL = (D.LOCAL_DATE, D.LOCAL_DATE_TIME, D.LOCAL_TIME, D.ZONED_DATE_TIME, D.YEAR, D.YEAR_MONTH)

# What each type widens to besides itself.
WIDENS: dict[DataType, frozenset[DataType]] = {
    D.INTEGER: frozenset((D.LONG, D.DOUBLE, D.BIG_INTEGER, D.BIG_DECIMAL, D.UNBOUND_INTEGER, D.UNBOUND_DECIMAL)),
    D.LONG: frozenset((D.BIG_INTEGER, D.BIG_DECIMAL, D.UNBOUND_INTEGER, D.UNBOUND_DECIMAL)),
    D.BIG_INTEGER: frozenset((D.UNBOUND_INTEGER, D.UNBOUND_DECIMAL)),
    D.UNBOUND_INTEGER: frozenset((D.UNBOUND_DECIMAL,)),
    D.DOUBLE: frozenset((D.UNBOUND_DECIMAL,)),
    D.BIG_DECIMAL: frozenset((D.UNBOUND_DECIMAL,)),
}


def parse_data_type(name: str) -> DataType | None:
    return DataType.__members__.get(name)


def is_numeric(t: DataType) -> bool:
    return t in WHOLE or t in FRACTIONAL


def is_assignable(data: DataType, schema: DataType) -> bool:
    return data == schema or data == D.NULL or schema in WIDENS.get(data, ())


def collapse_numeric(types: Iterable[DataType]) -> DataType:
    """The one numeric type for several: the widest whole one, else the widest fractional one if all widen to it."""
    types = list(types)
    if not types or not all(map(is_numeric, types)):
        raise ValueError("numeric types are needed")
    fractional = [t for t in types if t in FRACTIONAL]
    if not fractional:
        return max(types)
    widest = max(fractional)
    return widest if all(is_assignable(t, widest) for t in types) else D.UNBOUND_DECIMAL


class TypeSet:
    """Types seen at a path: at most one numeric type, and NULL only by itself."""

    def __init__(self, *types: DataType) -> None:
        self._types: list[DataType] = []
        for t in types:
            self.add(t)

    def add(self, t: DataType) -> bool:
        """Whether the set changed."""
        before = list(self._types)
        every = {*self._types, t}
        if len(every) > 1:
            every.discard(D.NULL)
        numeric = {x for x in every if is_numeric(x)}
        if len(numeric) > 1:
            every = every - numeric | {collapse_numeric(numeric)}
        self._types = sorted(every)
        return self._types != before

    def types(self) -> list[DataType]:
        return list(self._types)

    def union(self, other: TypeSet) -> TypeSet:
        return TypeSet(*self._types, *other._types)

    def is_polymorphic(self) -> bool:
        return len(self._types) > 1

    def is_empty(self) -> bool:
        return not self._types

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TypeSet) and self._types == other._types

    def __hash__(self) -> int:
        return hash(tuple(self._types))

    def __repr__(self) -> str:
        return f"TypeSet({', '.join(t.name for t in self._types)})"
