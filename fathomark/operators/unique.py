"""Composite unique keys: each entity's claims, and claims that meet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomark.errors import PartialUniqueKeyError
from fathomark.functions.slots import let

SEPARATOR = "\x1f"
# The bounds of numbers in keys.
MOST_DIGITS, MOST_EXPONENT = 64, 6144


@dataclass(frozen=True)
class UniqueKey:
    id: str
    fields: tuple[str, ...]


def _steps(field: str) -> list[str]:
    return [s for s in field.removeprefix("$").split(".") if s]


def _raw_number(data: Column, steps: list[str]) -> Column:
    """A number's text as the document has it, when it is whole and too long for exact types."""
    return F.get_json_object(data, "$" + "".join(f"['{s}']" for s in steps))


def canonical_number(text: Column) -> Column:
    """One text for equal numbers: digits without zeros around them, and the power of ten of the last."""
    sign = F.regexp_extract(text, r"^(-?)", 1)
    whole, part = F.regexp_extract(text, r"^[+-]?(\d*)", 1), F.regexp_extract(text, r"^[+-]?\d*\.(\d*)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0)) - F.length(part)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    bare = F.regexp_replace(digits, "0+$", "")
    return F.when(bare == "", F.lit("n:0")).otherwise(F.concat(F.lit("n:"), sign, bare, F.lit("e"), (power + F.length(digits) - F.length(bare)).cast("string")))


def _in_bounds(text: Column) -> Column:
    part = F.length(F.regexp_extract(text, r"\.(\d*)", 1))
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.when(text.rlike("[eE]"), F.lit(1 << 20)).otherwise(F.lit(0)))
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"^[+-]?([\d.]*)", 1), r"\.", ""))
    return (digits <= MOST_DIGITS) & (F.abs(power - part) <= MOST_EXPONENT)


def _field(doc: Column, data: Column, field: str) -> Column:
    """struct(token, there, error) of one field: its value is looked up once, and whole numbers need no regular expressions."""
    steps = _steps(field)
    none = F.lit(None).cast("string")
    if not steps:
        return F.struct(none.alias("token"), F.lit(0).alias("there"), none.alias("error"))
    views = lambda v: F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"), (v.isNotNull() & ~F.is_variant_null(v)).alias("there"))

    def made(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        whole = F.rtrim(text, F.lit("0"))
        plain = F.when(text == "0", F.lit("n:0")).otherwise(F.concat(F.lit("n:"), whole, F.lit("e"), (F.length(text) - F.length(whole)).cast("string")))
        # the document's own digits, where a double would have fewer
        digits = _raw_number(data, steps)
        raw = F.when(kind == "DOUBLE", F.when(digits.rlike(r"^-?\d+$"), digits).otherwise(text)).otherwise(text)
        number = (kind == "DOUBLE") | kind.startswith("DECIMAL")
        token = F.when(kind == "STRING", F.concat(F.lit("s"), F.octet_length(text).cast("string"), F.lit(":"), text)).when(kind == "BOOLEAN", F.concat(F.lit("b:"), text)).when(kind == "BIGINT", plain).when(number, let(raw, canonical_number))
        there = F.coalesce(x["there"], F.lit(False))
        error = F.when(there & ~(number | kind.isin("BIGINT", "STRING", "BOOLEAN")), F.lit(f"no scalar at {field}")).when(there & number & ~let(raw, _in_bounds), F.lit(f"number out of bounds at {field}"))
        return F.struct(token.alias("token"), there.cast("int").alias("there"), error.alias("error"))

    value = F.try_variant_get(doc, "$" + "".join(f'["{s}"]' for s in steps), "variant")
    return let(let(value, views), made)


def claim(doc: Column, data: Column, key: UniqueKey) -> Column:
    """struct(key_id, signature, error): the signature is null without a claim, the error if there is none."""

    def made(fields: Column) -> Column:
        n = F.aggregate(fields, F.lit(0), lambda a, x: a + x["there"])
        partial = F.when((n > 0) & (n < len(key.fields)), F.concat(F.lit(f"key {key.id} has only "), n.cast("string"), F.lit(f" of {len(key.fields)} fields")))
        error = F.coalesce(F.get(F.filter(F.transform(fields, lambda x: x["error"]), lambda e: e.isNotNull()), 0), partial)
        signature = F.when(error.isNull() & (n == len(key.fields)) & (n > 0), F.concat_ws(SEPARATOR, F.transform(fields, lambda x: x["token"])))
        return F.struct(F.lit(key.id).alias("key_id"), signature.alias("signature"), error.alias("error"))

    fields = [_field(doc, data, f) for f in key.fields]
    return let(F.array(*fields), made) if fields else F.struct(F.lit(key.id).alias("key_id"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("error"))


def claims(entities: DataFrame, keys: Sequence[UniqueKey]) -> DataFrame:
    """A row for each claim or error of each entity: its columns but data, key_id, signature, error."""
    kept = [c for c in entities.columns if c != "data"]
    made = let(F.try_parse_json("data"), lambda doc: F.array(*(claim(doc, F.col("data"), k) for k in keys)))
    return entities.select(*kept, F.explode(made).alias("_c")).select(*kept, "_c.*").where("signature is not null or error is not null")


def violations(made: DataFrame, scope: Sequence[str] = ("tenant_id", "model_name", "model_version")) -> DataFrame:
    """Signatures that more than one entity claims, with how many and the smallest id."""
    by = [c for c in scope if c in made.columns] + ["key_id", "signature"]
    found = made.where("signature is not null").groupBy(*by).agg(F.count_distinct("id").alias("n_entities"), F.min("id").alias("first_id"))
    return found.where("n_entities > 1")


def check_partial(made: DataFrame) -> None:
    row = made.where("error is not null").select("id", "error").first()
    if row is not None:
        raise PartialUniqueKeyError(f"{row.id}: {row.error}")
