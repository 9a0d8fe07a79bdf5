"""Operands expanded by the declared types of their path, once for each query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fathomark.functions import temporal as tm
from fathomark.functions.datatypes import FRACTIONAL, TEMPORAL, WHOLE, is_numeric
from fathomark.functions.datatypes import DataType as D
from fathomark.functions.decimals import DOUBLE_DIGITS, DOUBLE_SCALE, INT32, INT64, INT128, Dec, in_big_decimal, in_double
from fathomark.plans.filters import COMPARISONS, OPERATORS, RANGES, UNARY
from fathomark.plans.patterns import to_java

# The largest magnitudes of the bounded numeric types.
LIMITS: dict[D, tuple[Dec, Dec]] = {
    D.INTEGER: tuple(Dec(x, 0) for x in INT32),
    D.LONG: tuple(Dec(x, 0) for x in INT64),
    D.BIG_INTEGER: tuple(Dec(x, 0) for x in INT128),
    D.DOUBLE: (Dec(-(10**15 - 1), -278), Dec(10**15 - 1, -278)),
    D.BIG_DECIMAL: tuple(Dec(x, 18) for x in INT128),
}
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")


@dataclass(frozen=True)
class NumericTest:
    """A stored number of a type that widens to type is compared, or (value None) just has to be there."""

    type: D
    value: Dec | None
    op: str


@dataclass
class Expansion:
    kind: str
    op: str
    numeric: list[NumericTest] = field(default_factory=list)
    temporal: list[tuple[D, int, str]] = field(default_factory=list)
    others: list[tuple[D, object]] = field(default_factory=list)
    numeric_range: tuple[Dec, Dec, tuple[D, ...]] | None = None
    temporal_ranges: list[tuple[D, int, int]] = field(default_factory=list)
    text_range: tuple[str, str] | None = None
    operand: str = ""
    pattern: str | None = None

    @property
    def void(self) -> bool:
        """Whether the operand fits its types and still no value can match."""
        return self.kind == "compare" and not (self.numeric or self.temporal or self.others)


def _up(op: str) -> bool:
    return op in ("gte", "lt")


def expand_numeric(value: Dec, declared: list[D], op: str) -> list[NumericTest]:
    comparing = op in ("gt", "gte", "lt", "lte")
    whole: Dec | None = None
    if value.scale <= 0:
        whole = value.to_scale(0) if -value.scale < 100_000 else value
    elif comparing:
        whole = value.to_scale(0, _up(op))
    out = []
    for t in [t for t in declared if t in FRACTIONAL] + [t for t in declared if t in WHOLE]:
        v = whole if t in WHOLE else value
        if v is None:
            continue
        if t not in LIMITS:
            out.append(NumericTest(t, v, op))
            continue
        low, high = LIMITS[t]
        if v.compare(low) < 0:
            out += [NumericTest(t, None, op)] if op in ("gt", "gte") else []
        elif v.compare(high) > 0:
            out += [NumericTest(t, None, op)] if op in ("lt", "lte") else []
        elif t == D.DOUBLE and (v.precision() > DOUBLE_DIGITS or v.scale > DOUBLE_SCALE):
            if comparing:
                near = v.to_scale(DOUBLE_SCALE, _up(op)) if v.scale > DOUBLE_SCALE else v
                out.append(NumericTest(t, v.to_precision(DOUBLE_DIGITS, _up(op)) if near.precision() > DOUBLE_DIGITS else near, op))
        else:
            out.append(NumericTest(t, v, op))
    return out


def parse_operand(text: str, t: D) -> object | None:
    """A text as a value of type t, or None."""
    if is_numeric(t):
        d = Dec.maybe(text)
        d = d and d.strip()
        if d is None:
            return None
        if t in WHOLE:
            if d.scale > 0:
                return None
            if t == D.UNBOUND_INTEGER:
                return d
            low, high = LIMITS[t]
            return d if low.compare(d) <= 0 <= high.compare(d) else None
        return d if t == D.UNBOUND_DECIMAL or (in_double(d) if t == D.DOUBLE else in_big_decimal(d)) else None
    match t:
        case D.STRING:
            return text
        case D.CHARACTER:
            return text if len(text) == 1 else None
        case D.BOOLEAN:
            return {"true": True, "false": False}.get(text)
        case D.UUID_TYPE | D.TIME_UUID_TYPE:
            if not _UUID.fullmatch(text):
                return None
            return text if t == D.UUID_TYPE or text[14] == "1" else None
    return None


# The characters of a LIKE operand that stand for themselves in a regular expression only when escaped.
LIKE_SPECIAL = "[](){}.*+?$^|#<>-="


def like_pattern(text: str) -> str:
    """The regular expression of a LIKE operand: % is any run without line feeds, _ any one character, both literal after an odd run of backslashes."""
    out: list[str] = []
    run = 0
    for c in text:
        escaped = run % 2 == 1
        run = run + 1 if c == "\\" else 0
        if c in LIKE_SPECIAL:
            out.append("\\" + c)
        elif c in "_%" and escaped:
            out[-1] = c
        else:
            out.append({"_": ".", "%": ".*?"}.get(c, c))
    return "".join(out)


def expand_leaf(op: str, operand: str, values: list[str] | None, declared: list[D]) -> Expansion:
    """Raises ValueError where the operand fits none of the declared types."""
    if op not in OPERATORS.values():
        raise ValueError(f"{op!r} is no leaf")
    if op in UNARY:
        return Expansion("unary", op)
    numeric, temporal = [t for t in declared if is_numeric(t)], [t for t in declared if t in TEMPORAL]
    other = [t for t in declared if not is_numeric(t) and t not in TEMPORAL]
    if op in RANGES:
        return _range(op, values, numeric, temporal, other)
    if op not in COMPARISONS:
        e = Expansion("text", op, operand=operand)
        if op in ("like", "matches"):
            e.pattern = to_java(like_pattern(operand) if op == "like" else operand)
        return e
    e, fits = Expansion("compare", op), False
    if numeric and (d := Dec.maybe(operand)) is not None:
        e.numeric, fits = expand_numeric(d, numeric, op), True
    if temporal and tm.parse_natural(operand) is not None:
        e.temporal, fits = tm.expand_temporal(operand, temporal, op), True
    e.others = [(t, v) for t in other if (v := parse_operand(operand, t)) is not None]
    if not fits and not e.others:
        raise ValueError(f"{operand!r} fits no declared type")
    return e


def _range(op: str, values: list[str] | None, numeric: list[D], temporal: list[D], other: list[D]) -> Expansion:
    if values is None or len(values) != 2:
        raise ValueError("a range needs two bounds")
    e = Expansion("range", op)
    low, high = map(Dec.maybe, values)
    if numeric and low is not None and high is not None:
        e.numeric_range = (low, high, tuple(numeric))
    bounds = [tm.parse_natural(v) for v in values]
    if all(bounds):
        for t in temporal:
            at = [v.millis() if v.type == t else (made := tm.convert(v, t, "gt")) and made[0] for v in bounds]
            if None not in at:
                e.temporal_ranges.append((t, *at))
    if D.STRING in other:
        e.text_range = (values[0], values[1])
    if not (e.numeric_range or e.temporal_ranges or e.text_range):
        raise ValueError("the bounds fit no declared type")
    return e
