"""Types, decimals, temporal values and schemas."""

import itertools
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fathomark.functions import decimals as dec
from fathomark.functions.datatypes import DataType as D
from fathomark.functions.datatypes import TypeSet, collapse_numeric, is_assignable, is_numeric
from fathomark.functions.decimals import Dec
from fathomark.functions.schema import FieldDescriptor, ModelNode, NodeKind, fields_map, parse_model
from fathomark.functions.temporal import expand_temporal, parse_natural


def test_widening():
    assert is_assignable(D.INTEGER, D.DOUBLE) and not is_assignable(D.LONG, D.DOUBLE)
    assert not is_assignable(D.DOUBLE, D.BIG_DECIMAL) and not is_assignable(D.BIG_INTEGER, D.BIG_DECIMAL)
    assert all(is_assignable(t, D.UNBOUND_DECIMAL) for t in D if is_numeric(t))
    assert all(is_assignable(D.NULL, t) for t in D)


def test_collapse():
    assert collapse_numeric([D.INTEGER, D.LONG]) == D.LONG
    assert collapse_numeric([D.INTEGER, D.DOUBLE]) == D.DOUBLE
    assert collapse_numeric([D.LONG, D.DOUBLE]) == D.UNBOUND_DECIMAL
    with pytest.raises(ValueError):
        collapse_numeric([])
    with pytest.raises(ValueError):
        collapse_numeric([D.STRING])


def test_type_set():
    s = TypeSet(D.NULL, D.STRING, D.INTEGER, D.LONG)
    assert s.types() == [D.LONG, D.STRING] and s.is_polymorphic()
    assert not s.add(D.NULL) and s.add(D.BOOLEAN)
    assert TypeSet(D.NULL).types() == [D.NULL] and TypeSet().is_empty()
    assert TypeSet(D.INTEGER).union(TypeSet(D.DOUBLE)) == TypeSet(D.DOUBLE)


@pytest.mark.parametrize("text", ["", "+", ".", "0.", "NaN", "Inf", "1e", "1.2.3", "0x1", " 1", "1e99999999999", "1_0"])
def test_no_decimal(text):
    assert Dec.maybe(text) is None


@pytest.mark.parametrize(("text", "canonical"), [("5.", "5"), (".5", "0.5"), ("-0", "0"), ("1e3", "1000"), ("12.500", "12.5"), ("+7", "7"), ("1E-3", "0.001"), ("-1.0e2", "-100")])
def test_canonical(text, canonical):
    assert Dec.parse(text).canonical() == canonical
    assert Dec.from_json(f'"{text}"').strip() == Dec.parse(canonical).strip()


@given(st.decimals(allow_nan=False, allow_infinity=False, places=6), st.decimals(allow_nan=False, allow_infinity=False, places=3))
def test_compare(a, b):
    assert Dec.parse(str(a)).compare(Dec.parse(str(b))) == (a > b) - (a < b)


@pytest.mark.parametrize(
    ("text", "kind"),
    [("30.0", D.INTEGER), ("1e10", D.LONG), ("12.5", D.DOUBLE), ("9223372036854775808", D.BIG_INTEGER), ("1e39", D.UNBOUND_INTEGER), ("1.2345678901234567", D.BIG_DECIMAL), ("1.1234567890123456789", D.UNBOUND_DECIMAL), ("1e-293", D.UNBOUND_DECIMAL)],
)
def test_classify_number(text, kind):
    assert dec.classify_number(Dec.parse(text)) == kind


def test_rounding():
    assert Dec.parse("1.25").to_scale(1, True) == Dec(13, 1) and Dec.parse("-1.25").to_scale(1, True) == Dec(-12, 1)
    assert Dec.parse("-1.25").to_scale(1, False) == Dec(-13, 1)
    assert Dec.parse("99999").to_precision(3, True).compare(Dec.parse("100000")) == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("2024", D.YEAR), ("2024-06", D.YEAR_MONTH), ("2024-06-01", D.LOCAL_DATE), ("10:30", D.LOCAL_TIME), ("10:30:05.5", D.LOCAL_TIME), ("2024-06-01T10:30", D.LOCAL_DATE_TIME), ("2024-06-01T10:30:00", D.LOCAL_DATE_TIME),
        ("2024-06-01T10:30Z", D.ZONED_DATE_TIME), ("2024-06-01T10:30:00.25+02:00", D.ZONED_DATE_TIME), ("2024-13", None), ("24", None), ("2024-02-30", None), ("x", None), ("", None), ("2024-06-01 10:30", None), ("+2024", None),
    ],
)
def test_natural(text, kind):
    v = parse_natural(text)
    assert (v and v.type) == kind


def test_millis():
    assert parse_natural("1970-01-01T00:00:00Z").millis() == 0
    assert parse_natural("1969-12-31T23:59:59.9999Z").millis() == -1
    assert parse_natural("2024-01-01T02:00:00+02:00").millis() == parse_natural("2024-01-01T00:00:00Z").millis()
    assert parse_natural("00:00:01").millis() == 1000


@pytest.mark.parametrize(
    ("text", "to", "op", "out"),
    [
        ("2031-05-17", D.YEAR, "gte", "gt"), ("2031-05-17", D.YEAR, "lt", "lte"), ("2024-01-01", D.YEAR, "gte", "gte"), ("2031-05-17", D.YEAR, "eq", None), ("2024", D.ZONED_DATE_TIME, "eq", "eq"),
        ("2031-05-17T10:00", D.LOCAL_TIME, "gte", "gte"), ("10:00", D.YEAR, "gt", None), ("10:00", D.ZONED_DATE_TIME, "gt", "gt"), ("2024-05-05T00:00:00Z", D.LOCAL_DATE, "lt", "lt"), ("2024-05-05T01:00:00Z", D.LOCAL_DATE, "ne", "ne"),
    ],
)
def test_expand_temporal(text, to, op, out):
    made = expand_temporal(text, [to], op)
    assert [m[2] for m in made] == ([out] if out else [])


def test_fields_map():
    tree = {"kind": "OBJECT", "children": {"items": {"kind": "ARRAY", "element": {"kind": "OBJECT", "types": ["LONG"], "children": {"id": {"kind": "LEAF", "types": ["UUID_TYPE"]}}}}, "n": {"kind": "OBJECT", "types": ["NULL"]}, "tags": {"kind": "ARRAY", "element": {"kind": "LEAF", "types": ["STRING"]}}, "e": {"kind": "ARRAY"}}}
    fields = fields_map(json.dumps(tree))
    assert {k: f.types for k, f in fields.items()} == {"$.items[*]": (D.LONG,), "$.items[*].id": (D.UUID_TYPE,), "$.tags[*]": (D.STRING,)}
    assert [fields[k].is_array for k in sorted(fields)] == [False, False, True]
    assert fields_map(b"") == {}


def test_model_nodes():
    root, rows = ModelNode.of_object(), ModelNode.of_object()
    root.set_child("rows", ModelNode.of_array(rows))
    root.set_child("unseen", ModelNode.of_array())
    assert root.fields() == [] and rows.kind is NodeKind.OBJECT and root.child("unseen").element is None
    rows.set_child("at", ModelNode.of_leaf(D.YEAR))
    assert root.fields() == [FieldDescriptor("$.rows[*].at", (D.YEAR,))]
    handed = root.children
    handed.pop("rows")
    assert root.child("rows").element is rows and root.child("none") is None and ModelNode.of_leaf(D.YEAR).children == {}
    rows.child("at").types.add(D.STRING)
    assert root.fields()[0].types == (D.STRING, D.YEAR)


@pytest.mark.parametrize("bad", ["{", '{"kind":"X"}', '{"kind":"LEAF","types":["NOPE"]}', '{"kind":"OBJECT","children":{"a":null}}', "[]"])
def test_bad_schema(bad):
    with pytest.raises(ValueError):
        parse_model(bad)


def test_all_pairs_of_numeric_types_collapse_to_a_common_one():
    for a, b in itertools.product([t for t in D if is_numeric(t)], repeat=2):
        c = collapse_numeric([a, b])
        assert c in (a, b, D.UNBOUND_DECIMAL)
