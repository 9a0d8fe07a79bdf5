"""Entity views: DataFrames with lifecycle columns, a JSON document, and paths promoted to typed columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomark.functions.datatypes import DataType as D
from fathomark.functions.schema import FieldDescriptor
from fathomark.plans.compile import META, SCALAR, EntityColumns
from fathomark.plans.conditions import Condition, parse_condition
from fathomark.plans.filters import Filter, condition_to_filter

LIFECYCLE = tuple(dict.fromkeys(META.values()))


@dataclass
class EntityView:
    """df has the columns of LIFECYCLE that are known, data (JSON text) and the promoted columns."""

    df: DataFrame
    fields: Mapping[str, FieldDescriptor] = field(default_factory=dict)
    promoted: dict[str, str] = field(default_factory=dict)

    def columns(self, doc: Column | None = None) -> EntityColumns:
        kinds = {f.name: f.dataType for f in self.df.schema}
        if doc is None and "data" in kinds:
            doc = F.try_parse_json(F.col("data"))
        return EntityColumns(doc, {n: kinds[n] for n in LIFECYCLE if n in kinds}, {p: (c, kinds[c]) for p, c in self.promoted.items()})

    def filter_of(self, condition: Condition | Filter | str | None) -> Filter:
        if condition is None:
            return Filter()
        if isinstance(condition, str):
            condition = parse_condition(condition)
        return condition if isinstance(condition, Filter) else condition_to_filter(condition, self.fields)

    def over(self, df: DataFrame) -> EntityView:
        return EntityView(df, self.fields, self.promoted)


def declared(**types: D | tuple[D, ...]) -> dict[str, FieldDescriptor]:
    """Fields by name; two underscores stand for a dot, a last underscore for elements of an array."""
    out = {}
    for name, t in types.items():
        array = name.endswith("_")
        path = "$." + name.removesuffix("_").replace("__", ".") + ("[*]" if array else "")
        out[path] = FieldDescriptor(path, t if isinstance(t, tuple) else (t,), array)
    return out


def entities(df: DataFrame, *, id: Column, data: Mapping[str, Column], fields: Mapping[str, FieldDescriptor] | None = None, promote: bool = True, **lifecycle: Column) -> EntityView:
    """A view of a typed table: data names the document's members; scalars, and arrays and structs of them, are promoted."""
    doc = F.to_json(F.struct(*(c.alias(n) for n, c in data.items())), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"})
    rows = df.select(id.cast("string").alias("id"), *(c.alias(n) for n, c in lifecycle.items()), *(c.alias(f"p_{n}") for n, c in data.items()), doc.alias("data"))
    kinds = {f.name: f.dataType for f in rows.schema}
    promoted = {n: f"p_{n}" for n in data if promote and isinstance(kinds[f"p_{n}"], (*SCALAR, T.ArrayType, T.StructType))}
    return EntityView(rows.drop(*(f"p_{n}" for n in data if n not in promoted)), fields or {}, promoted)
