"""Compiled filters: a table of leaves, quirks, and random ones against a plain evaluator."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomark.errors import UnknownOperatorError
from fathomark.functions.datatypes import DataType as D
from fathomark.plans import conditions as c
from fathomark.plans.compile import EntityColumns, compile_filter
from fathomark.plans.expand import like_pattern
from fathomark.plans.filters import OPERATORS, Coercion, Filter, Source, condition_to_filter, lookup_operator, normalise_path, operator_names, validate_operators
from fathomark.plans.patterns import to_java
from fathomark.sources.entities import declared
from tests.plain import leaf, load, lookup, matches

I, L, S, DBL, BD, UD, UI = D.INTEGER, D.LONG, D.STRING, D.DOUBLE, D.BIG_DECIMAL, D.UNBOUND_DECIMAL, D.UNBOUND_INTEGER
UUID1, UUID4 = "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "f47ac10b-58cc-4372-a567-0e02b2c3d479"

# operator, operand, declared types, stored JSON (None: absent), expected
LEAVES = [
    ("eq", "30", (I,), "30", True), ("eq", "30", (I,), "30.0", True), ("eq", "30", (I,), '"30"', False), ("eq", "30.0", (I,), "30", False), ("eq", "3e1", (I,), "30", True),
    ("ne", "12.5", (I,), "30", False), ("eq", "12.5", (BD,), "12.5", False), ("gt", "0", (DBL,), "5000000000", False), ("gt", "0", (L,), "5000000000", True), ("lt", "5e9", (I,), "-3", True),
    ("lt", "5e9", (I,), "5000000000", False), ("gt", "-5e9", (I,), "7", True), ("gt", "5e9", (I,), "7", False), ("gte", "12.5", (I,), "13", True), ("gte", "12.5", (I,), "12", False), ("lte", "12.5", (I,), "12", True),
    ("gt", "12.5", (I,), "13", True), ("gt", "12.5", (I,), "12", False), ("lt", "12.5", (I,), "12", True), ("lt", "-12.5", (I,), "-12", False), ("eq", "12.5", (DBL,), "12.5", True), ("eq", "12.5", (UD,), "12.5", True),
    ("eq", "0.1234567890123456", (DBL,), "0.1234567890123456", False), ("eq", "1234567890.1234567", (BD,), "1234567890.1234567", True), ("ne", "30", (I,), "null", False), ("ne", "30", (I,), None, False),
    ("eq", "a", (S,), '"a"', True), ("gt", "a", (S,), '"b"', True), ("lt", "é", (S,), '"z"', True), ("eq", "1", (S,), "1", False), ("eq", "x", (I,), "1", False), ("eq", "x", (D.CHARACTER,), '"x"', True), ("gt", "x", (D.CHARACTER,), '"yy"', False),
    ("eq", "true", (D.BOOLEAN,), "true", True), ("ne", "true", (D.BOOLEAN,), "false", True), ("gt", "true", (D.BOOLEAN,), "true", False), ("eq", "True", (D.BOOLEAN,), "true", False),
    ("eq", UUID4, (D.UUID_TYPE,), f'"{UUID4.upper()}"', True), ("eq", UUID4, (D.UUID_TYPE,), f'"{{{UUID4}}}"', True), ("ne", UUID4, (D.UUID_TYPE,), '"nope"', False), ("eq", UUID4, (D.TIME_UUID_TYPE,), f'"{UUID4}"', False), ("eq", UUID1, (D.TIME_UUID_TYPE,), f'"urn:uuid:{UUID1}"', True),
    ("gte", "2031-05-17", (D.YEAR,), '"2031"', False), ("gte", "2031-05-17", (D.YEAR,), '"2032"', True), ("eq", "2031-05-17", (D.YEAR,), '"2031"', False), ("lt", "2031-05-17", (D.YEAR,), '"2031"', True),
    ("eq", "2031", (D.LOCAL_DATE,), '"2031-01-01"', True), ("gte", "2031-01-01T00:00Z", (D.ZONED_DATE_TIME,), '"2031-01-01T02:00:00+02:00"', True), ("eq", "2031-01-01T00:00:00Z", (D.LOCAL_DATE_TIME,), '"2031-01-01T00:00:00Z"', False),
    ("eq", "2031-01-01T00:00:00Z", (D.LOCAL_DATE_TIME,), '"2031-01-01T00:00"', True), ("eq", "10:30", (D.LOCAL_TIME,), '"10:30:00"', True), ("lt", "2031-08", (D.YEAR_MONTH,), '"2031-05"', True), ("eq", "2031-02-30", (D.LOCAL_DATE,), '"2031-02-30"', False),
    ("eq", "2031", (D.YEAR, S), '"2031"', True), ("eq", "30", (I, S), '"30"', True), ("ne", "30", (I, S), '"31"', True), ("eq", "[1]", (D.BYTE_ARRAY,), '"[1]"', False),
    ("contains", "ag", (), '"Magda"', True), ("contains", "", (), '""', True), ("not_contains", "x", (), '"Magda"', True), ("not_contains", "x", (), "null", False), ("not_contains", "x", (), "5", False), ("starts_with", "Ma", (), '"Magda"', True), ("not_starts_with", "Ma", (), '"Bob"', True),
    ("ends_with", "da", (), '"Magda"', True), ("not_ends_with", "da", (), '"Magda"', False), ("ieq", "mAgDA", (), '"Magda"', True), ("ieq", "k", (), '"\\u212a"', True), ("ine", "magda", (), '"Magda"', False), ("icontains", "AGD", (), '"Magda"', True), ("inot_contains", "AGD", (), '"Magda"', False),
    ("istarts_with", "MA", (), '"magda"', True), ("inot_starts_with", "MA", (), '"bob"', True), ("iends_with", "DA", (), '"magda"', True), ("inot_ends_with", "DA", (), '"bob"', True), ("ieq", "a\\E.b", (), '"A\\\\E.B"', True),
    ("like", "M%a", (), '"Magda"', True), ("like", "M_gda", (), '"Magda"', True), ("like", "a%", (), '"Magda"', False), ("like", "A%", (), '"A\\nb"', False), ("like", "100\\\\%", (), '"100%"', False), ("like", "100\\%", (), '"100%"', True), ("like", "a.c", (), '"abc"', False), ("like", "", (), '""', True), ("like", "\\d%", (), '"5x"', True), ("like", "abc\\", (), '"abc"', False),
    ("matches", "M[a-z]+", (), '"Magda"', True), ("matches", "agd", (), '"Magda"', False), ("matches", "(", (), '"("', False), ("matches", "(?=A).*", (), '"A"', False), ("matches", "a|b", (), '"b"', True),
    ("is_null", None, (), None, True), ("is_null", None, (), "null", True), ("is_null", None, (), '""', False), ("not_null", None, (), "[]", True), ("not_null", None, (), "{}", True), ("not_null", None, (), None, False),
    ("between", ["1", "3"], (I,), "2", True), ("between", ["1", "3"], (I,), "1", False), ("between_inclusive", ["1", "3"], (I,), "3.0", True), ("between_inclusive", ["1.5", "2.5"], (I,), "2", True), ("between", ["a", "c"], (S,), '"b"', True), ("between", ["1", "3"], (I,), '"2"', False), ("between", ["1"], (I,), "2", False),
    ("between_inclusive", ["2031-01-01", "2031-02-01"], (D.LOCAL_DATE,), '"2031-01-15"', True), ("between_inclusive", ["2031", "2032"], (D.LOCAL_DATE,), '"2031-01-01"', True), ("between", ["2031-01-01T00:00:00Z", "2031-02-01T00:00:00Z"], (D.LOCAL_DATE,), '"2031-01-15"', True),
]


def evaluate(spark, cases):
    """cases: (Filter, document text); all in a few jobs."""
    out = []
    where = EntityColumns(F.try_parse_json(F.col("data")))
    for k in range(0, len(cases), 40):
        part = cases[k : k + 40]
        docs = spark.createDataFrame([tuple(d for _, d in part)], T.StructType([T.StructField(f"d{i}", T.StringType()) for i in range(len(part))]))
        columns = [compile_filter(f, EntityColumns(F.try_parse_json(F.col(f"d{i}")))) for i, (f, _) in enumerate(part)]
        out += [bool(x) for x in docs.select(*(x.alias(f"r{i}") for i, x in enumerate(columns))).first()]
    assert where.doc is not None
    return out


def test_leaves(spark):
    cases, want = [], []
    for op, operand, types, stored, expected in LEAVES:
        values = tuple(operand) if isinstance(operand, list) else None
        f = Filter(op, "v", Source.DATA, None if values else operand, values if values and len(values) == 2 else None, types)
        cases.append((f, "{}" if stored is None else f'{{"v":{stored}}}'))
        want.append(expected)
    wrong = [(LEAVES[i], got) for i, got in enumerate(evaluate(spark, cases)) if got != want[i]]
    assert not wrong, wrong
    for (op, operand, types, stored, expected), (_, doc) in zip(LEAVES, cases, strict=True):
        values = operand if isinstance(operand, list) else None
        assert leaf(op, operand, types, lookup(load(doc), "v"), values) == expected, (op, operand, types, stored)


class Shelf:
    """Documents and filters over them, drawn from a seed: a parcel with a code, a weight, a date, marks and a depot."""

    NUMBERS = ("41", "41.0", "40", "-17", "8.5", "8.25", "2147483647", "2147483648", "-2147483649", "0.125", "123456789012345678", "1e3", "1e20", "0.12345678901234567", "-0.5", "99999999999999999999")
    TEXTS = ("Birk", "birk", "Oslo kommune", "ba%k", "", "x", "Ørsted", "41", "true", "c0ffee00-1234-4abc-8def-000000000001", "C0FFEE00-1234-4ABC-8DEF-000000000001", "two\nlines")
    TIMES = ("1999", "2031", "2031-05", "2031-05-17", "2031-01-01", "2031-05-17T08:15", "2031-05-17T08:15:30.250", "2031-05-17T08:15:30Z", "2031-05-17T10:15:30+02:00", "2031-01-01T00:00:00Z", "08:15", "23:59:59.5")
    PATTERNS = ("B%", "%k", "_irk", "ba\\%k", "[A-Z][a-z]+", "birk|Birk", "(", ".*", "%lines", "\\d+")
    PATHS = ("code", "weight", "due", "paid", "nothing", "depot.zone", "depot.7", "marks.0", "marks.1", "marks.2.deep", "weight.0")
    TYPES = ((I,), (L,), (DBL,), (BD,), (UD,), (UI,), (S,), (D.CHARACTER,), (D.BOOLEAN,), (D.UUID_TYPE,), (D.LOCAL_DATE,), (D.ZONED_DATE_TIME,), (D.LOCAL_DATE_TIME,), (D.YEAR,), (D.YEAR_MONTH,), (D.LOCAL_TIME,), (I, S), (D.YEAR, D.LOCAL_DATE, S), (L, DBL), (I, BD, D.BOOLEAN), ())
    META = {"id": "id", "state": "state", "model_name": "model_name", "transitionForLatestSave": "transition", "nowhere": None}

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def scalar(self):
        kind = self.rng.random()
        return self.rng.choice(self.NUMBERS) if kind < 0.35 else json.dumps(self.rng.choice(self.TEXTS)) if kind < 0.6 else json.dumps(self.rng.choice(self.TIMES)) if kind < 0.85 else self.rng.choice(("true", "false", "null", "[]", "{}"))

    def document(self):
        pick = self.rng.random
        members = {name: self.scalar() for name in ("code", "weight", "due", "paid") if pick() < 0.9}
        if pick() < 0.7:
            members["depot"] = "{" + ",".join(f'"{k}":{self.scalar()}' for k in ("zone", "7") if pick() < 0.8) + "}"
        if pick() < 0.7:
            members["marks"] = "[" + ",".join([self.scalar() for _ in range(self.rng.randrange(3))] + ([f'{{"deep":{self.scalar()}}}'] if pick() < 0.5 else [])) + "]"
        return "{" + ",".join(f'"{k}":{v}' for k, v in members.items()) + "}"

    def operand(self, op):
        return self.rng.choice(self.PATTERNS if op in ("like", "matches") and self.rng.random() < 0.8 else (*self.NUMBERS, *self.TEXTS, *self.TIMES))

    def filter(self, depth=2):
        if depth and self.rng.random() < 0.45:
            return Filter(self.rng.choice(("and", "or")), children=tuple(self.filter(depth - 1) for _ in range(self.rng.randrange(4))))
        op, meta = self.rng.choice(list(OPERATORS.values())), self.rng.random() < 0.15
        path, types = (self.rng.choice(list(self.META)), (S,)) if meta else (self.rng.choice(self.PATHS), self.rng.choice(self.TYPES))
        values = (self.operand(op), self.operand(op)) if op.startswith("between") else None
        return Filter(op, path, Source.META if meta else Source.DATA, None if values else self.operand(op), values, types)

    def row(self, k):
        return (f"p{k}", self.rng.choice(("Birk", "open", "", None)), "parcel", self.rng.choice(("41", None, "x")), self.document())


@pytest.mark.parametrize("seed", range(4))
def test_random_filters(spark, seed):
    """Each of 75 filters, with groups and lifecycle fields, over each of 80 documents: 24,000 pairs in all."""
    shelf = Shelf(seed)
    rows = [shelf.row(k) for k in range(80)]
    df = spark.createDataFrame(rows, "id string, state string, model_name string, transition string, data string").coalesce(1).cache()
    where = EntityColumns(F.try_parse_json(F.col("data")), {f.name: f.dataType for f in df.schema})
    known = [(load(r[4]), {"id": r[0], "state": r[1], "model_name": r[2], "transitionForLatestSave": r[3]}) for r in rows]
    hits = 0
    for _ in range(5):
        filters = [shelf.filter() for _ in range(15)]
        got = df.select(*(F.coalesce(compile_filter(f, where), F.lit(False)).alias(f"r{i}") for i, f in enumerate(filters))).collect()
        for k, (doc, meta) in enumerate(known):
            for i, f in enumerate(filters):
                want = matches(f, doc, meta)
                hits += want
                assert got[k][i] == want, (f, rows[k])
    assert 300 < hits < 5700
    df.unpersist()


def test_groups(spark):
    t, f = Filter("eq", "v", value="1", declared=(I,)), Filter("eq", "v", value="2", declared=(I,))
    doc = '{"v":1}'
    every = [
        (Filter(), True), (Filter("and"), True), (Filter("or"), False), (Filter("and", children=(t, f)), False), (Filter("or", children=(f, t)), True), (Filter("and", children=(t, Filter())), False),
        (Filter("or", children=(Filter("and", children=(t, t)), f)), True), (Filter("and", children=(t, Filter("or"))), False),
    ]
    assert evaluate(spark, [(x, doc) for x, _ in every]) == [w for _, w in every]


def test_meta(spark):
    rows = [("1", "new", 3, None), ("2", "", 1, None)]
    df = spark.createDataFrame(rows, "id string, state string, version long, creation_date timestamp").withColumn("creation_date", F.when(F.col("id") == "1", F.timestamp_micros(F.lit(1704067200123456))))
    where = EntityColumns(None, {f.name: f.dataType for f in df.schema})

    def ids(field, op, value):
        return [r.id for r in df.where(compile_filter(condition_to_filter(c.Lifecycle(field, op, value)), where)).orderBy("id").collect()]

    assert ids("state", "EQUALS", "new") == ["1"] and ids("state", "IS_NULL", None) == [] and ids("state", "NOT_EQUAL", "x") == ["1", "2"]
    assert ids("version", "EQUALS", "3") == []
    assert ids("creationDate", "GREATER_OR_EQUAL", "2024") == ["1"] and ids("creationDate", "EQUALS", "2024-01-01T00:00:00.123Z") == ["1"] and ids("creationDate", "GREATER_THAN", "2024-01-01T00:00:00.123Z") == []
    assert ids("creationDate", "BETWEEN", ["2023", "2025"]) == ["1"] and ids("creationDate", "IS_NULL", None) == ["2"] and ids("unknown", "IS_NULL", None) == ["1", "2"]
    with pytest.raises(ValueError):
        ids("creationDate", "CONTAINS", "2024")


def test_promoted_paths_reach_the_scan(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("p_v"), F.lit("{}").alias("data"))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    where = EntityColumns(F.try_parse_json("data"), {"id": T.StringType()}, {"v": ("p_v", T.LongType())})
    found = df.where(compile_filter(Filter("gt", "v", value="5", declared=(L,)), where))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_v,5)" in plan and sorted(int(r.id) for r in found.select("id").collect()) == [6, 7, 8, 9]
    assert "data" not in found.select("id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_parse_and_write():
    body = '{"type":"group","operator":"OR","conditions":[{"type":"simple","jsonPath":"$.a","operator":"EQUALS","value":1.50},{"type":"lifecycle","field":"state","operation":"EQUALS","value":"x"},{"type":"array","jsonPath":"$.l","values":[1,null,"b"]},{"type":"function"}]}'
    tree = c.parse_condition(body)
    assert tree.conditions[0].operator == "EQUALS" and tree.conditions[0].value == "1.50" and isinstance(tree.conditions[0].value, c.Number)
    assert c.parse_condition(c.write_condition(tree)) == tree and '"value":1.50' in c.write_condition(tree)
    assert json.loads(c.write_condition(c.Group("AND", None)))["conditions"] == []
    deep = '{"type":"group","conditions":[' * 51 + '{"type":"function"}' + "]}" * 51
    with pytest.raises(ValueError):
        c.parse_condition(deep)
    assert c.parse_condition('{"type":"group","conditions":[' * 50 + '{"type":"function"}' + "]}" * 50)
    for bad in ("", "[]", '{"type":"nope"}', '{"type":"simple","jsonPath":5}', '{"type":"group","conditions":5}'):
        with pytest.raises(ValueError):
            c.parse_condition(bad)


def test_translate():
    fields = declared(a=D.INTEGER, d=D.LOCAL_DATE, l_=D.STRING)
    f = condition_to_filter(c.Simple("$.a", "EQUALS", c.Number("5")), fields)
    assert f.path == "a" and f.declared == (D.INTEGER,) and f.coercion is Coercion.NONE
    assert condition_to_filter(c.Simple("$.d", "EQUALS", "2024"), fields).coercion is Coercion.TEMPORAL
    assert condition_to_filter(c.Array("$.l", [None, "x"]), fields) == Filter("eq", "l.1", Source.DATA, "x", declared=(D.STRING,))
    assert condition_to_filter(c.Array("$.l", [None]), fields) == Filter("and")
    assert condition_to_filter(c.Group("xor", []), fields).op == "and" and condition_to_filter(c.Group("oR", []), fields).op == "or"
    assert condition_to_filter(c.Lifecycle("previousTransition", "EQUALS", "t")).path == "transitionForLatestSave"
    assert condition_to_filter(c.Simple("$.a", "BETWEEN", [1, 2, 3]), fields).values is None
    for bad in (c.Function(), None, c.Simple("$.a[*]", "EQUALS", 1), c.Simple("$.a b", "EQUALS", 1)):
        with pytest.raises(ValueError):
            condition_to_filter(bad, fields)
    with pytest.raises(UnknownOperatorError):
        lookup_operator("equals")
    with pytest.raises(UnknownOperatorError):
        validate_operators(c.Group("AND", [c.Simple("$.a", "NOPE")]))
    tree = c.Simple("$.a", "EQUALS", 1)
    for _ in range(300):
        tree = c.Group("AND", [tree])
    with pytest.raises(ValueError):
        validate_operators(tree)
    assert len(operator_names()) == 26 and normalise_path(" a.b ") == "$.a.b" and normalise_path("$") == "$"


def test_patterns():
    assert like_pattern("a%b_c\\%d\\_") == "a.*?b.c%d_" and like_pattern("\\\\%") == "\\\\.*?"
    assert to_java("a*+") is None and to_java("(a)\\1") is None and to_java("(?P<n>a)") == "(?<n>a)"


# pattern, texts that match as a whole, texts that don't
PATTERNS = [
    ("[[:digit:]]+", ["123"], [":dig", "12x"]), ("[a&&b]+", ["a&b", "b"], ["c"]), ("[[:^digit:]]x", ["ax"], ["1x"]), ("[[:alpha:]_]+", ["ab_"], ["a1"]), ("\\Qa.b*\\E+", ["a.b*", "a.b**"], ["axb"]), ("a(?i)b", ["ab", "aB"], ["Ab"]), ("(?i:a)b", ["Ab"], ["AB"]),
    ("(?s)a.b", ["a\nb"], ["ab"]), ("a.b", ["axb"], ["a\nb"]), ("[]a]+", ["]a"], ["b"]), ("[[a]+", ["[a"], ["]"]), ("\\pL+", ["äb"], ["1"]), ("\\p{Greek}", ["λ"], ["l"]), ("\\p{^Lu}", ["a"], ["A"]), ("\\s", [" ", "\t"], ["\x0b"]), ("[\\s\\d]+", ["1 2"], ["a"]), ("\\v", ["\x0b"], ["\n"]),
    ("a$", ["a"], ["a\n"]), ("\\x41", ["A"], ["a"]), ("\\101", ["A"], ["1"]), ("a{2,3}?", ["aa"], ["a"]), ("(?P<y>[0-9]{4})", ["2031"], ["31"]), ("\\QX", ["X"], ["x"]), ("[^[:space:]]", ["a"], [" "]), ("a|b|", ["", "a"], ["c"]), ("[a-c~#]+", ["~#a"], ["d"]),
]
NO_PATTERNS = ["(?=a)", "(?<!a)b", "(a)\\1", "a**", "a*+", "a++", "a?+", "\\Z", "\\h", "\\k<n>", "[[:nope:]]", "[a", "(", "a{2}+", "(?U)a", "(?>a)", "\\"]


def test_regular_expressions(spark):
    cases = [(Filter("matches", "v", value=p), json.dumps({"v": t}), want) for p, yes, no in PATTERNS for want, texts in ((True, yes), (False, no)) for t in texts]
    cases += [(Filter("matches", "v", value=p), '{"v":"a"}', False) for p in NO_PATTERNS]
    got = evaluate(spark, [(f, d) for f, d, _ in cases])
    assert [(f.value, d) for (f, d, want), g in zip(cases, got, strict=True) if g != want] == []
    assert all(to_java(p) is None for p in NO_PATTERNS) and all(to_java(p) for p, _, _ in PATTERNS)
