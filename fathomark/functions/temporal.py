"""Temporal texts: their sub-type, their milliseconds, and operands carried from one sub-type to another."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from fathomark.functions.datatypes import DataType as D

_DATE = r"(\d{4})-(\d{2})-(\d{2})"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
SHAPES: dict[D, re.Pattern] = {
    D.ZONED_DATE_TIME: re.compile(rf"{_DATE}T{_TIME}(Z|[+-]\d{{2}}:\d{{2}})\Z", re.ASCII),
    D.LOCAL_DATE_TIME: re.compile(rf"{_DATE}T{_TIME}\Z", re.ASCII),
    D.LOCAL_DATE: re.compile(rf"{_DATE}\Z", re.ASCII),
    D.LOCAL_TIME: re.compile(rf"{_TIME}\Z", re.ASCII),
    D.YEAR_MONTH: re.compile(r"(\d{4})-(\d{2})\Z", re.ASCII),
    D.YEAR: re.compile(r"(\d{4})\Z", re.ASCII),
}
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Temporal:
    """A wall clock (with nanoseconds beyond its microseconds) and, for zoned ones, an offset in seconds."""

    type: D
    wall: datetime
    offset: int = 0
    nanos: int = 0

    def millis(self) -> int:
        return (self.wall - timedelta(seconds=self.offset) - _EPOCH) // timedelta(milliseconds=1)


def parse_as(text: str, t: D) -> Temporal | None:
    """Text read as sub-type t; a zoned text can be read as a local date and time, without its zone."""
    m = SHAPES[t].match(text) if t in SHAPES else None
    if m is None:
        zoned = parse_as(text, D.ZONED_DATE_TIME) if t == D.LOCAL_DATE_TIME else None
        return zoned and Temporal(t, zoned.wall, nanos=zoned.nanos)
    g, offset = list(m.groups()), 0
    if t == D.ZONED_DATE_TIME and (zone := g.pop()) != "Z":
        hours, minutes = int(zone[1:3]), int(zone[4:6])
        if hours > 24 or minutes > 59:
            return None
        offset = (hours * 3600 + minutes * 60) * (1 if zone[0] == "+" else -1)
    fraction = ""
    if t in (D.ZONED_DATE_TIME, D.LOCAL_DATE_TIME, D.LOCAL_TIME):
        fraction = ((g.pop() or "") + "0" * 9)[:9]
    parts = [int(x or 0) for x in g]
    if t == D.LOCAL_TIME:
        parts = [1970, 1, 1, *parts]
    parts += [1] * (3 - len(parts))
    if parts[0] == 0:
        return None
    try:
        return Temporal(t, datetime(*parts, microsecond=int(fraction[:6] or 0)), offset, int(fraction[6:] or 0))
    except ValueError:
        return None


def parse_natural(text: str) -> Temporal | None:
    """Text read as the one sub-type whose shape it has."""
    return next((v for t in SHAPES if (v := parse_as(text, t)) is not None), None)


@dataclass(frozen=True)
class _Edge:
    to: D
    convert: Callable[[Temporal], Temporal]
    exact: Callable[[Temporal], bool] = lambda v: True
    changes_op: bool = True


def _floor(to: D, **parts: int) -> Callable[[Temporal], Temporal]:
    return lambda v: Temporal(to, v.wall.replace(**parts), nanos=0 if "microsecond" in parts else v.nanos)


_MIDNIGHT = {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}
COARSER: dict[D, tuple[_Edge, ...]] = {
    D.YEAR_MONTH: (_Edge(D.YEAR, _floor(D.YEAR, month=1), lambda v: v.wall.month == 1),),
    D.LOCAL_DATE: (_Edge(D.YEAR_MONTH, _floor(D.YEAR_MONTH, day=1), lambda v: v.wall.day == 1),),
    D.LOCAL_DATE_TIME: (
        _Edge(D.LOCAL_DATE, _floor(D.LOCAL_DATE, **_MIDNIGHT), lambda v: v.wall == v.wall.replace(**_MIDNIGHT) and not v.nanos),
        _Edge(D.LOCAL_TIME, _floor(D.LOCAL_TIME, year=1970, month=1, day=1), lambda v: v.wall.date() == _EPOCH.date(), changes_op=False),
    ),
    D.ZONED_DATE_TIME: (_Edge(D.LOCAL_DATE_TIME, lambda v: Temporal(D.LOCAL_DATE_TIME, v.wall, nanos=v.nanos)),),
}
FINER: dict[D, D] = {D.YEAR: D.YEAR_MONTH, D.YEAR_MONTH: D.LOCAL_DATE, D.LOCAL_DATE: D.LOCAL_DATE_TIME, D.LOCAL_TIME: D.LOCAL_DATE_TIME, D.LOCAL_DATE_TIME: D.ZONED_DATE_TIME}


def _coarser_path(start: D, to: D) -> tuple[_Edge, ...] | None:
    for e in COARSER.get(start, ()):
        rest = () if e.to == to else _coarser_path(e.to, to)
        if rest is not None:
            return (e, *rest)
    return None


def convert(value: Temporal, to: D, op: str) -> tuple[int, str] | None:
    """Milliseconds and operator of a comparison with values of sub-type to, or None if there is none.

    On the way to a coarser sub-type, what is cut off makes an equality impossible, and turns "at
    least" into "after" and "before" into "not after".
    """
    path = _coarser_path(value.type, to)
    if path is not None:
        out = op
        for e in path:
            if not e.exact(value):
                if op == "eq":
                    return None
                if e.changes_op:
                    out = {"gte": "gt", "lt": "lte"}.get(op, op)
            value = e.convert(value)
        return value.millis(), out
    t = value.type
    while t in FINER and t != to:
        t = FINER[t]
    return (replace(value, type=to, offset=0).millis(), op) if t == to and t != value.type else None


def expand_temporal(text: str, declared: list[D], op: str) -> list[tuple[D, int, str]]:
    value = parse_natural(text)
    if value is None:
        return []
    found = [(t, (value.millis(), op) if t == value.type else convert(value, t, op)) for t in declared]
    return [(t, *made) for t, made in found if made is not None]
