"""Stored values as Columns: where a leaf's value is, what kind of JSON value it is, and its views.

A slot is a path into a JSON document (a VARIANT), or a typed column that stands for one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomark.functions.datatypes import DataType as D

#: Stored sub-types: the shape that a text must have, and what makes a timestamp of it.
_DATE, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?"
TEXT_SHAPES: dict[D, tuple[str, str, str]] = {
    D.ZONED_DATE_TIME: (rf"{_DATE}T{_TIME}(Z|[+-]\d{{2}}:\d{{2}})", "", ""),
    D.LOCAL_DATE_TIME: (rf"{_DATE}T{_TIME}", "", "Z"),
    D.LOCAL_DATE: (_DATE, "", "T00:00:00Z"),
    D.LOCAL_TIME: (_TIME, "1970-01-01T", "Z"),
    D.YEAR_MONTH: (r"\d{4}-\d{2}", "", "-01T00:00:00Z"),
    D.YEAR: (r"\d{4}", "", "-01-01T00:00:00Z"),
}


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def temporal_millis(text: Column, t: D) -> Column:
    """Milliseconds of a text of natural sub-type t; null for every other text."""
    shape, before, after = TEXT_SHAPES[t]
    full = F.concat(F.lit(before), text, F.lit(after)) if before or after else text
    if t in (D.ZONED_DATE_TIME, D.LOCAL_DATE_TIME, D.LOCAL_TIME):
        full = F.regexp_replace(F.regexp_replace(full, r"T(\d{1,2}:\d{2})(?=[Z+\-]|$)", "T$1:00"), ",", ".")
    return F.when(text.rlike(rf"\A{shape}\z"), F.unix_millis(F.try_to_timestamp(full)))


def classify_temporal(text: Column) -> Column:
    """Name of a text's natural sub-type, or null."""
    return F.coalesce(*(F.when(temporal_millis(text, t).isNotNull(), F.lit(t.name)) for t in TEXT_SHAPES))


class Slot:
    """Views of a stored value; each is null where the value is of another kind."""

    text: Column
    present: Column
    boolean: Column
    number: Column
    number_text: Column
    whole: Column
    approximate: Column

    def decimal(self, scale: int = 18) -> Column:
        return F.when(self.number, self.number_text.try_cast(f"decimal(38,{scale})"))

    def significant_digits(self) -> Column:
        mantissa = F.regexp_replace(F.regexp_extract(self.number_text, r"^-?([0-9.]+)", 1), r"\.", "")
        return F.greatest(F.length(F.regexp_replace(F.ltrim(mantissa, F.lit("0")), "0+$", "")), F.lit(1))

    def fits_double(self) -> Column:
        """Whether a number has at most 15 significant digits: those with two decimals are told without their text."""
        x = self.approximate
        return ((F.abs(x) < 1e13) & (F.rint(x * 100) / 100 == x)) | (self.significant_digits() <= 15)

    def widens_to(self, t: D) -> Column:
        """Whether the stored number's own type widens to t."""
        whole = F.when(self.whole, self.approximate)
        exact = F.when(self.whole, self.decimal(0))
        part = self.number & ~self.whole
        match t:
            case D.INTEGER:
                return whole.between(-(2.0**31), 2.0**31 - 1)
            case D.LONG:
                return F.coalesce(exact.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(False))
            case D.BIG_INTEGER:
                return exact.isNotNull()
            case D.UNBOUND_INTEGER:
                return self.whole
            case D.DOUBLE:
                return F.when(self.whole, self.approximate.between(-(2.0**31), 2.0**31 - 1)).otherwise(part & self.fits_double())
            case D.BIG_DECIMAL:
                return F.when(self.whole, self.widens_to(D.LONG)).otherwise(part & ~self.fits_double() & self.decimal().isNotNull())
        return self.number


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def at_path(doc: Column, path: str) -> Column:
    """The value at a dotted path of a VARIANT; a numeric step is an index or, in objects, a name."""
    paths = ["$"]
    for step in path.split("."):
        name = f'["{step}"]'
        paths = [p + x for p in paths for x in ([f"[{int(step)}]", name] if re.fullmatch(r"[0-9]{1,9}", step) else [name])]
    return F.coalesce(*(F.try_variant_get(doc, p, "variant") for p in paths)) if len(paths) > 1 else F.try_variant_get(doc, paths[0], "variant")


class JsonSlot(Slot):
    """A value inside a document, from its kind, its text and its double."""

    def __init__(self, kind: Column, text: Column, double: Column) -> None:
        self.kind, self.any_text = kind, text
        self.present = kind.isNotNull() & (kind != "VOID")
        self.text = F.when(kind == "STRING", text)
        self.boolean = F.when(kind == "BOOLEAN", text == "true")
        self.number = F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))
        self.number_text = F.when(self.number, text)
        self.approximate = F.when(self.number, double)
        self.whole = self.number & F.when(kind == "BIGINT", True).when(kind == "DOUBLE", (F.abs(double) >= 2.0**53) | (double == F.rint(double))).otherwise(text.rlike(r"^-?[0-9]+(\.0*)?$"))

    @staticmethod
    def views(v: Column) -> tuple[Column, Column, Column]:
        return F.schema_of_variant(v), F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")

    @classmethod
    def of(cls, doc: Column, path: str) -> JsonSlot:
        return cls(*cls.views(at_path(doc, path)))

    @classmethod
    def bound(cls, doc: Column, path: str, body: Callable[[JsonSlot], Column]) -> Column:
        """body over a slot whose views are computed once."""
        parts = let(at_path(doc, path), lambda v: F.struct(*(c.alias(n) for n, c in zip("ktd", cls.views(v), strict=True))))
        return let(parts, lambda x: body(cls(x["k"], x["t"], x["d"])))


class TypedSlot(Slot):
    """A typed column that holds a path's value in a promoted form."""

    def __init__(self, column: Column, kind: T.DataType) -> None:
        none = F.lit(None)
        self.any_text = column
        self.present = column.isNotNull()
        numeric = isinstance(kind, T.NumericType)
        self.text = column if isinstance(kind, T.StringType) else none.cast("string")
        self.boolean = column if isinstance(kind, T.BooleanType) else none.cast("boolean")
        self.number = column.isNotNull() if numeric else F.lit(False)
        self.number_text = column.cast("string") if numeric else none.cast("string")
        self.approximate = column.cast("double") if numeric else none.cast("double")
        self.integral = isinstance(kind, T.IntegralType)
        self.narrow = isinstance(kind, T.ByteType | T.ShortType | T.IntegerType)
        self.column, self.double = column, isinstance(kind, T.DoubleType)
        self.whole = column.isNotNull() if self.integral else column == F.rint(column.cast("double")) if numeric else F.lit(False)
        if not isinstance(kind, T.StringType):
            self.any_text = column.cast("string")

    def decimal(self, scale: int = 18) -> Column:
        return F.when(self.number, self.column.try_cast(f"decimal(38,{scale})")) if self.integral else super().decimal(scale)

    def widens_to(self, t: D) -> Column:
        if not self.integral:
            return super().widens_to(t)
        if self.narrow or t in (D.LONG, D.BIG_INTEGER, D.UNBOUND_INTEGER, D.UNBOUND_DECIMAL, D.BIG_DECIMAL):
            return self.column.isNotNull()
        return self.column.between(-(1 << 31), (1 << 31) - 1)
