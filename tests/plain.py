"""A plain evaluator of filters over Python values. It shares nothing with the engine but the names of types: numbers
are Python decimals, times are datetimes, and what an operand means for a declared type is worked out for each value anew."""

import json
import math
import re
from datetime import datetime, timedelta
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal

# The ranges of the numeric types, and how natural types widen.
INT, LONG, BIG = 2**31, 2**63, 2**127
RANGE = {
    "INTEGER": (Decimal(-INT), Decimal(INT - 1)), "LONG": (Decimal(-LONG), Decimal(LONG - 1)), "BIG_INTEGER": (Decimal(-BIG), Decimal(BIG - 1)), "DOUBLE": (Decimal(-(10**15 - 1)).scaleb(278), Decimal(10**15 - 1).scaleb(278)),
    "BIG_DECIMAL": (Decimal(-BIG).scaleb(-18, Context(prec=60)), Decimal(BIG - 1).scaleb(-18, Context(prec=60))),
}
INTEGERS, DECIMALS = ("INTEGER", "LONG", "BIG_INTEGER", "UNBOUND_INTEGER"), ("DOUBLE", "BIG_DECIMAL", "UNBOUND_DECIMAL")
WIDER = {"INTEGER": {*INTEGERS, *DECIMALS}, "LONG": {"LONG", "BIG_INTEGER", "UNBOUND_INTEGER", "BIG_DECIMAL", "UNBOUND_DECIMAL"}, "DOUBLE": {"DOUBLE", "UNBOUND_DECIMAL"}, "BIG_DECIMAL": {"BIG_DECIMAL", "UNBOUND_DECIMAL"}}
WIDER |= {"BIG_INTEGER": {"BIG_INTEGER", "UNBOUND_INTEGER", "UNBOUND_DECIMAL"}, "UNBOUND_INTEGER": {"UNBOUND_INTEGER", "UNBOUND_DECIMAL"}, "UNBOUND_DECIMAL": {"UNBOUND_DECIMAL"}}
NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class Raw(str):
    """A JSON number as it was written."""


def load(text):
    def pairs(items):
        out = {}
        for k, v in items:
            out.setdefault(k, v)
        return out

    return json.loads(text, parse_int=Raw, parse_float=Raw, object_pairs_hook=pairs)


def lookup(doc, path):
    for step in path.split("."):
        if isinstance(doc, list):
            doc = doc[int(step)] if step.isdigit() and int(step) < len(doc) else None
        else:
            doc = doc.get(step) if isinstance(doc, dict) else None
    return doc


def test(op, a, b):
    return {"eq": a == b, "ne": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


# numbers


def digits(x):
    return len(str(abs(int("".join(map(str, x.normalize(Context(prec=400)).as_tuple().digits))))))


def natural_number(x):
    """The type of a stored number: a whole one by its size, else by its digits."""
    if x == x.to_integral_value():
        return next((t for t, n in zip(INTEGERS, (INT, LONG, BIG), strict=False) if -n <= x < n), "UNBOUND_INTEGER")
    if digits(x) <= 15 and -x.normalize().as_tuple().exponent <= 292:
        return "DOUBLE"
    return "BIG_DECIMAL" if -x.normalize(Context(prec=400)).as_tuple().exponent <= 18 and abs(x) < BIG * Decimal("1e-18") else "UNBOUND_DECIMAL"


def written_scale(text):
    mantissa, _, power = text.lower().partition("e")
    return len(mantissa.partition(".")[2]) - int(power or 0)


def number_matches(op, operand, types, x):
    """Whether the stored number x matches one of the declared numeric types."""
    value, kind = Decimal(operand), natural_number(x)
    for t in types:
        if t not in WIDER[kind]:
            continue
        v = value
        if t in INTEGERS and written_scale(operand) > 0:
            if op in ("eq", "ne"):
                continue
            v = v.to_integral_value(ROUND_CEILING if op in ("gte", "lt") else ROUND_FLOOR)
        low, high = RANGE.get(t, (None, None))
        if low is not None and v < low:
            if op in ("gt", "gte"):
                return True
            continue
        if high is not None and v > high:
            if op in ("lt", "lte"):
                return True
            continue
        if t == "DOUBLE" and len(v.as_tuple().digits) > 15:
            if op in ("eq", "ne"):
                continue
            v = Context(prec=15, rounding=ROUND_CEILING if op in ("gte", "lt") else ROUND_FLOOR).plus(v)
        if test(op, x, v):
            return True
    return False


# times

KINDS = {
    "ZONED_DATE_TIME": r"(\d{4})-(\d\d)-(\d\d)T(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(Z|[+-]\d\d:\d\d)", "LOCAL_DATE_TIME": r"(\d{4})-(\d\d)-(\d\d)T(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?", "LOCAL_DATE": r"(\d{4})-(\d\d)-(\d\d)",
    "LOCAL_TIME": r"()()()(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?", "YEAR_MONTH": r"(\d{4})-(\d\d)", "YEAR": r"(\d{4})",
}
ZERO = datetime(1970, 1, 1)


def natural_time(text):
    """(kind, wall clock, minutes east) or None."""
    for kind, pattern in KINDS.items():
        m = re.fullmatch(pattern, text, re.ASCII)
        if m:
            y, mo, d, h, mi, s, part, zone = [*m.groups(), *[None] * 8][:8]
            try:
                wall = datetime(int(y or 1970), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int(((part or "") + "000000")[:6]))
            except ValueError:
                return None
            east = 0 if zone in (None, "Z") else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[4:6]))
            return kind, wall, east
    return None


def millis(wall, east=0):
    return math.floor((wall - timedelta(minutes=east) - ZERO) / timedelta(milliseconds=1))


LADDER = ["ZONED_DATE_TIME", "LOCAL_DATE_TIME", "LOCAL_DATE", "YEAR_MONTH", "YEAR"]


def carried(kind, wall, east, to, op):
    """The operand as a value of another kind: (milliseconds, operator), or None where no value can match."""
    if kind == to:
        return millis(wall, east), op
    if kind == "LOCAL_TIME":
        return (millis(wall), op) if to in ("LOCAL_DATE_TIME", "ZONED_DATE_TIME") else None
    if to == "LOCAL_TIME":
        if kind not in ("LOCAL_DATE_TIME", "ZONED_DATE_TIME") or op == "eq" and wall.date() != ZERO.date():
            return None
        return millis(datetime.combine(ZERO.date(), wall.time())), op
    if LADDER.index(to) < LADDER.index(kind):
        return millis(wall), op
    starts = {"LOCAL_DATE_TIME": wall, "LOCAL_DATE": datetime(wall.year, wall.month, wall.day), "YEAR_MONTH": datetime(wall.year, wall.month, 1), "YEAR": datetime(wall.year, 1, 1)}
    start = starts[to]
    if start != wall:
        if op == "eq":
            return None
        op = {"gte": "gt", "lt": "lte"}.get(op, op)
    return millis(start), op


# leaves


def text_matches(op, operand, text):
    if op == "like":
        return like(operand, text)
    if op == "matches":
        if re.search(r"\(\?[=!<>]|\\[1-9]", operand):
            return False
        try:
            return re.fullmatch(operand, text) is not None
        except re.error:
            return False
    if op.startswith("i"):
        text, operand = text.lower(), operand.lower()
    negated = "not_" in op or op == "ine"
    plain = {"ieq": "is", "ine": "is"}.get(op, op.removeprefix("i").removeprefix("not_"))
    hit = {"is": text == operand, "contains": operand in text, "starts_with": text.startswith(operand), "ends_with": text.endswith(operand)}[plain]
    return hit != negated


def like(pattern, text):
    """By hand: % takes any run without line feeds, _ any other character."""
    if not pattern:
        return not text
    c, rest = pattern[0], pattern[1:]
    if c == "\\":
        # before % and _ it makes them literal; before anything else it is an escape of regular expressions
        one = rest[:1] if rest[:1] in ("%", "_") else None
        return bool(rest and text) and (text[0] == one if one else re.fullmatch(c + rest[0], text[0], re.ASCII) is not None) and like(rest[1:], text[1:])
    if c == "%":
        return like(rest, text) or text != "" and text[0] != "\n" and like(pattern, text[1:])
    return text != "" and (text[0] == c or c == "_" and text[0] != "\n") and like(rest, text[1:])


def bare_uuid(text):
    text = text.lower()
    text = text.removeprefix("urn:uuid:") if text.startswith("urn:uuid:") else text[1:-1] if text[:1] == "{" and text[-1:] == "}" else text
    return text.replace("-", "") if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", text) else None


def leaf(op, operand, declared, stored, values=None):
    types = [t.name for t in declared]
    if op in ("is_null", "not_null"):
        return (stored is None) == (op == "is_null")
    if stored is None:
        return False
    number = Decimal(str(stored)) if isinstance(stored, Raw) else None
    text = stored if isinstance(stored, str) and number is None else None
    numeric = [t for t in types if t in RANGE or t.startswith("UNBOUND")]
    if op.startswith("between"):
        within = lambda x, a, b: a <= x <= b if op == "between_inclusive" else a < x < b
        if len(values) != 2:
            return False
        if number is not None:
            return all(map(NUMBER.fullmatch, values)) and any(t in WIDER[natural_number(number)] for t in numeric) and within(number, *map(Decimal, values))
        if text is None:
            return False
        at, bounds = natural_time(text), list(map(natural_time, values))
        if at and at[0] in types and all(bounds):
            edges = [carried(*b, at[0], "gt") for b in bounds]
            if None not in edges and within(millis(*at[1:]), *(e[0] for e in edges)):
                return True
        return "STRING" in types and within(text, *values)
    if op not in ("eq", "ne", "gt", "gte", "lt", "lte"):
        return text is not None and text_matches(op, operand, text)
    if number is not None:
        return NUMBER.fullmatch(operand) is not None and number_matches(op, operand, numeric, number)
    if isinstance(stored, bool):
        return "BOOLEAN" in types and operand in ("true", "false") and op in ("eq", "ne") and test(op, stored, operand == "true")
    if text is None:
        return False
    at, wanted = natural_time(text), natural_time(operand)
    if at and wanted and at[0] in types:
        made = carried(*wanted, at[0], op)
        if made and test(made[1], millis(*at[1:]), made[0]):
            return True
    if "STRING" in types and test(op, text, operand) or "CHARACTER" in types and len(operand) == len(text) == 1 and test(op, text, operand):
        return True
    uuid = re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-([0-9a-f])[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}", operand)
    if uuid and ("UUID_TYPE" in types or "TIME_UUID_TYPE" in types and uuid[1] == "1") and op in ("eq", "ne"):
        return bare_uuid(text) is not None and test(op, bare_uuid(text), operand.replace("-", ""))
    return False


def matches(f, doc, meta):
    """A whole filter: an unknown or null lifecycle field is absent, an empty operator below the root matches nothing."""
    if f.op in ("and", "or"):
        return (all if f.op == "and" else any)(matches(c, doc, meta) for c in f.children)
    if not f.op:
        return False
    stored = meta.get(f.path) if f.source.value == "meta" else lookup(doc, f.path)
    return leaf(f.op, f.value, f.declared, stored, None if f.values is None else list(f.values))
