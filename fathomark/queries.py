"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.errors import SearchResultLimitExceededError
from fathomark.functions.datatypes import DataType as D
from fathomark.functions.schema import fields_map
from fathomark.functions.slots import classify_temporal
from fathomark.operators import aggregate, search, unique
from fathomark.operators.search import OrderKind, OrderSpec
from fathomark.plans.conditions import parse_condition, write_condition
from fathomark.plans.filters import Source
from fathomark.sources import context
from fathomark.sources.entities import EntityView, declared, entities
from fathomark.sources.shared import remove, scratch, written
from fathomark.sources.store import Entity, ModelRef, Transaction
from fathomark.sources.tables import ChangeLevel, Engine
from fathomark.streaming import schedule
from fathomark.streaming.jobs import numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad(c: str, n: int = 12):
    return F.lpad(F.col(c).cast("string"), n, "0")


def simple(path: str, op: str, value=None) -> dict:
    return {"type": "simple", "jsonPath": f"$.{path}", "operatorType": op, "value": value}


def lifecycle(field: str, op: str, value=None) -> dict:
    return {"type": "lifecycle", "field": field, "operatorType": op, "value": value}


def both(*conditions: dict, operator: str = "AND") -> dict:
    return {"type": "group", "operator": operator, "conditions": list(conditions)}


# entity views of the test tables; *_json ones have no promoted paths and read the document


def ent_events(spark: SparkSession, sf_dir: str, promote: bool = True) -> EntityView:
    e = table(spark, sf_dir, "events")
    props = F.try_parse_json("props")
    return entities(
        e.withColumn("_k", F.try_variant_get(props, "$.k", "int")),
        id=pad("event_id"), state=F.col("event_type"), creation_date=F.col("ts"), version=F.lit(1).cast("long"),
        data={"value": F.col("value"), "user_id": F.col("user_id"), "event_type": F.col("event_type"), "props": F.struct(F.col("_k").alias("k")), "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "day": F.date_format("ts", "yyyy-MM-dd")},
        fields=declared(value=D.DOUBLE, user_id=D.LONG, event_type=D.STRING, props__k=D.INTEGER, ts=D.ZONED_DATE_TIME, day=D.LOCAL_DATE), promote=promote,
    )


def ent_orders(spark: SparkSession, sf_dir: str, promote: bool = True) -> EntityView:
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return entities(
        o, id=pad("o_orderkey"), state=F.col("o_orderstatus"), creation_date=F.col("o_orderdate"),
        data={
            "custkey": F.col("o_custkey"), "total": F.col("o_totalprice"), "priority": F.col("o_orderpriority"), "date": day, "month": F.substr(day, F.lit(1), F.lit(7)), "year": F.substr(day, F.lit(1), F.lit(4)),
            "wide": F.col("o_custkey") + F.lit(5_000_000_000), "maybe": F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")), "pair": F.array(F.col("o_custkey") % 3, F.col("o_custkey") % 5), "mixed": F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.substr(day, F.lit(1), F.lit(4))),
        },
        fields=declared(custkey=D.LONG, total=D.DOUBLE, priority=D.STRING, date=D.LOCAL_DATE, month=D.YEAR_MONTH, year=D.YEAR, wide=D.DOUBLE, maybe=D.STRING, pair_=D.LONG, mixed=(D.LOCAL_DATE, D.YEAR)), promote=promote,
    )


def ent_lineitem(spark: SparkSession, sf_dir: str, promote: bool = True) -> EntityView:
    li = table(spark, sf_dir, "lineitem")
    return entities(
        li, id=F.concat(pad("l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")), state=F.col("l_returnflag"), creation_date=F.col("l_shipdate"),
        data={"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "line": F.col("l_linenumber"), "status": F.col("l_linestatus"), "partkey": F.col("l_partkey")},
        fields=declared(quantity=D.DOUBLE, price=D.DOUBLE, discount=D.DOUBLE, line=D.INTEGER, status=D.STRING, partkey=D.LONG), promote=promote,
    )


def ent_parts(spark: SparkSession, sf_dir: str) -> EntityView:
    p = table(spark, sf_dir, "part")
    return entities(p, id=pad("p_partkey"), state=F.col("p_brand"), data={"name": F.col("p_name"), "type": F.col("p_type"), "size": F.col("p_size")}, fields=declared(name=D.STRING, type=D.STRING, size=D.INTEGER), promote=False)


def ent_tokens(spark: SparkSession, sf_dir: str) -> EntityView:
    """Orders with UUIDs in several notations, texts of one character and more, and booleans."""
    o = table(spark, sf_dir, "orders")
    plain = F.format_string("%08d-0000-4000-8000-000000000000", F.col("o_custkey") % 50)
    stamp = F.when(F.col("o_orderkey") % 2 == 0, F.replace(plain, F.lit("-4000-"), F.lit("-1000-"))).otherwise(plain)
    token = F.when(F.col("o_orderkey") % 3 == 0, plain).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("urn:uuid:"), plain)).otherwise(F.upper(F.regexp_replace(plain, "-", "")))
    letter = F.when(F.col("o_orderkey") % 3 == 0, F.repeat("o_orderstatus", 2)).otherwise(F.col("o_orderstatus"))
    return entities(o, id=pad("o_orderkey"), creation_date=F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")), data={"token": token, "stamp": stamp, "letter": letter, "urgent": F.col("o_orderpriority") == "1-URGENT"}, fields=declared(token=D.UUID_TYPE, stamp=D.TIME_UUID_TYPE, letter=D.CHARACTER, urgent=D.BOOLEAN), promote=False)


def ids(view: EntityView, condition: dict) -> DataFrame:
    return search.filtered(view, json.dumps(condition)).select("id")


_ORDER_ID = "lpad(o_orderkey::varchar, 12, '0') AS id"
_EVENT_ID = "lpad(event_id::varchar, 12, '0') AS id"
_LINE_ID = "lpad(l_orderkey::varchar, 12, '0') || '-' || l_linenumber AS id"
_PART_ID = "lpad(p_partkey::varchar, 12, '0') AS id"

_FLAGSHIP = both(lifecycle("state", "EQUALS", "purchase"), simple("value", "GREATER_THAN", 20))


@query("SELECT event_type AS state, count(*) AS count, round(avg(value), 4) AS avg_value, round(stddev_samp(value), 4) AS stdev_value FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY 1")
def flagship_grouped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate.grouped(ent_events(spark, sf_dir), [aggregate.GroupExpr(is_state=True)], json.dumps(_FLAGSHIP), [aggregate.AggregateExpr("avg", "$.value"), aggregate.AggregateExpr("stdev", "$.value")])
    return rows.select("state", "count", F.round("avg_value", 4).alias("avg_value"), F.round("stdev_value", 4).alias("stdev_value"))


@query(ORACLES["flagship_grouped_stats"])
def json_grouped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over documents, without promoted paths."""
    rows = aggregate.grouped(ent_events(spark, sf_dir, promote=False), [aggregate.GroupExpr(is_state=True)], json.dumps(_FLAGSHIP), [aggregate.AggregateExpr("avg", "$.value"), aggregate.AggregateExpr("stdev", "$.value")])
    return rows.select("state", "count", F.round("avg_value", 4).alias("avg_value"), F.round("stdev_value", 4).alias("stdev_value"))


# Leaves: name, view, condition, SQL for the same rows.
_LEAVES: tuple[tuple[str, Callable[[SparkSession, str], EntityView], dict, str], ...] = (
    ("leaf_eq_string", ent_orders, simple("priority", "EQUALS", "2-HIGH"), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderpriority = '2-HIGH'"),
    ("leaf_ne_string", ent_orders, simple("priority", "NOT_EQUAL", "2-HIGH"), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderpriority <> '2-HIGH'"),
    ("leaf_eq_int", ent_events, simple("props.k", "EQUALS", 7), f"SELECT {_EVENT_ID} FROM events WHERE (props::json ->> 'k')::int = 7"),
    ("leaf_gt_double", ent_orders, simple("total", "GREATER_THAN", 300000.5), f"SELECT {_ORDER_ID} FROM orders WHERE o_totalprice > 300000.5"),
    ("leaf_lt", ent_lineitem, simple("price", "LESS_THAN", 2000), f"SELECT {_LINE_ID} FROM lineitem WHERE l_extendedprice < 2000"),
    ("leaf_gte", ent_lineitem, simple("quantity", "GREATER_OR_EQUAL", 49), f"SELECT {_LINE_ID} FROM lineitem WHERE l_quantity >= 49"),
    ("leaf_lte", ent_lineitem, simple("discount", "LESS_OR_EQUAL", 0.01), f"SELECT {_LINE_ID} FROM lineitem WHERE l_discount <= 0.01"),
    ("leaf_between_exclusive", ent_lineitem, simple("line", "BETWEEN", [2, 5]), f"SELECT {_LINE_ID} FROM lineitem WHERE l_linenumber > 2 AND l_linenumber < 5"),
    ("leaf_between_inclusive", ent_lineitem, simple("line", "BETWEEN_INCLUSIVE", [2, 3]), f"SELECT {_LINE_ID} FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3"),
    ("leaf_is_null", ent_orders, simple("maybe", "IS_NULL"), f"SELECT {_ORDER_ID} FROM orders WHERE nullif(o_orderpriority, '1-URGENT') IS NULL"),
    ("leaf_not_null", ent_orders, simple("maybe", "NOT_NULL"), f"SELECT {_ORDER_ID} FROM orders WHERE nullif(o_orderpriority, '1-URGENT') IS NOT NULL"),
    ("leaf_contains", ent_parts, simple("name", "CONTAINS", "d r"), f"SELECT {_PART_ID} FROM part WHERE contains(p_name, 'd r')"),
    ("leaf_not_contains", ent_parts, simple("name", "NOT_CONTAINS", "l"), f"SELECT {_PART_ID} FROM part WHERE NOT contains(p_name, 'l')"),
    ("leaf_starts_with", ent_parts, simple("type", "STARTS_WITH", "S"), f"SELECT {_PART_ID} FROM part WHERE starts_with(p_type, 'S')"),
    ("leaf_not_starts_with", ent_parts, simple("type", "NOT_STARTS_WITH", "S"), f"SELECT {_PART_ID} FROM part WHERE NOT starts_with(p_type, 'S')"),
    ("leaf_ends_with", ent_parts, simple("name", "ENDS_WITH", "ing"), f"SELECT {_PART_ID} FROM part WHERE ends_with(p_name, 'ing')"),
    ("leaf_not_ends_with", ent_parts, simple("name", "NOT_ENDS_WITH", "t"), f"SELECT {_PART_ID} FROM part WHERE NOT ends_with(p_name, 't')"),
    ("leaf_like", ent_parts, simple("name", "LIKE", "_o% r_n%"), f"SELECT {_PART_ID} FROM part WHERE p_name LIKE '_o% r_n%'"),
    ("leaf_matches_posix_class", ent_parts, simple("type", "MATCHES_PATTERN", "[[:alpha:]]{5}|(?i)economy"), f"SELECT {_PART_ID} FROM part WHERE regexp_full_match(p_type, '[A-Za-z]{{5}}|(?i:economy)')"),
    ("leaf_matches", ent_parts, simple("type", "MATCHES_PATTERN", "[A-M].*"), f"SELECT {_PART_ID} FROM part WHERE regexp_full_match(p_type, '[A-M].*')"),
    ("leaf_ieq", ent_orders, simple("priority", "IEQUALS", "2-high"), f"SELECT {_ORDER_ID} FROM orders WHERE lower(o_orderpriority) = '2-high'"),
    ("leaf_ine", ent_orders, simple("priority", "INOT_EQUAL", "2-high"), f"SELECT {_ORDER_ID} FROM orders WHERE lower(o_orderpriority) <> '2-high'"),
    ("leaf_icontains", ent_orders, simple("priority", "ICONTAINS", "urg"), f"SELECT {_ORDER_ID} FROM orders WHERE contains(lower(o_orderpriority), 'urg')"),
    ("leaf_inot_contains", ent_orders, simple("priority", "INOT_CONTAINS", "urg"), f"SELECT {_ORDER_ID} FROM orders WHERE NOT contains(lower(o_orderpriority), 'urg')"),
    ("leaf_istarts", ent_parts, simple("type", "ISTARTS_WITH", "s"), f"SELECT {_PART_ID} FROM part WHERE starts_with(lower(p_type), 's')"),
    ("leaf_inot_starts", ent_parts, simple("type", "INOT_STARTS_WITH", "s"), f"SELECT {_PART_ID} FROM part WHERE NOT starts_with(lower(p_type), 's')"),
    ("leaf_iends", ent_orders, simple("priority", "IENDS_WITH", "LOW"), f"SELECT {_ORDER_ID} FROM orders WHERE ends_with(lower(o_orderpriority), 'low')"),
    ("leaf_inot_ends", ent_orders, simple("priority", "INOT_ENDS_WITH", "LOW"), f"SELECT {_ORDER_ID} FROM orders WHERE NOT ends_with(lower(o_orderpriority), 'low')"),
    ("leaf_uuid", lambda s, d: ent_tokens(s, d), simple("token", "EQUALS", "00000007-0000-4000-8000-000000000000"), f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey % 50 = 7"),
    ("leaf_time_uuid", lambda s, d: ent_tokens(s, d), simple("stamp", "EQUALS", "00000007-0000-1000-8000-000000000000"), f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey % 50 = 7 AND o_orderkey % 2 = 0"),
    ("leaf_character", lambda s, d: ent_tokens(s, d), simple("letter", "GREATER_OR_EQUAL", "O"), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus >= 'O'"),
    ("leaf_boolean", lambda s, d: ent_tokens(s, d), simple("urgent", "NOT_EQUAL", True), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderpriority <> '1-URGENT'"),
    ("leaf_operator_alias", ent_orders, {"type": "simple", "jsonPath": "$.priority", "operator": "ENDS_WITH", "value": "M"}, f"SELECT {_ORDER_ID} FROM orders WHERE ends_with(o_orderpriority, 'M')"),
    ("meta_created_at_micros", lambda s, d: ent_tokens(s, d), both(lifecycle("created_at", "NOT_NULL"), lifecycle("creationDate", "IS_NULL")), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderstatus = 'F'"),
    ("int_fold_ceiling", ent_orders, simple("custkey", "GREATER_OR_EQUAL", 99.5), f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey >= 100"),
    ("int_fold_floor", ent_orders, simple("custkey", "LESS_OR_EQUAL", 99.5), f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey <= 99"),
    ("void_eq_fraction", ent_orders, simple("custkey", "EQUALS", 99.5), f"SELECT {_ORDER_ID} FROM orders WHERE false"),
    ("out_of_range_not_null", ent_lineitem, simple("line", "LESS_THAN", 5_000_000_000), f"SELECT {_LINE_ID} FROM lineitem WHERE l_linenumber IS NOT NULL"),
    ("long_not_assignable_double", ent_orders, simple("wide", "GREATER_THAN", 0), f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey + 5000000000 BETWEEN -2147483648 AND 2147483647"),
    ("temporal_zdt_gte", ent_events, simple("ts", "GREATER_OR_EQUAL", "2024-01-15T00:00:00Z"), f"SELECT {_EVENT_ID} FROM events WHERE ts >= timestamp '2024-01-15 00:00:00'"),
    ("temporal_date_between", ent_orders, simple("date", "BETWEEN_INCLUSIVE", ["1995-03-01", "1995-06-30"]), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderdate::date BETWEEN date '1995-03-01' AND date '1995-06-30'"),
    ("temporal_year_downscale", ent_orders, simple("year", "GREATER_OR_EQUAL", "1995-09-09"), f"SELECT {_ORDER_ID} FROM orders WHERE year(o_orderdate) > 1995"),
    ("temporal_poly_year_date", ent_orders, simple("mixed", "LESS_THAN", "1997-05-05"), f"SELECT {_ORDER_ID} FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate < timestamp '1997-05-05 00:00:00' ELSE year(o_orderdate) <= 1997 END"),
    ("meta_coarse_operand", ent_orders, lifecycle("creationDate", "GREATER_OR_EQUAL", "1996"), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderdate >= timestamp '1996-01-01 00:00:00'"),
    ("meta_state_filter", ent_orders, lifecycle("state", "EQUALS", "F"), f"SELECT {_ORDER_ID} FROM orders WHERE o_orderstatus = 'F'"),
    ("array_positional", ent_orders, {"type": "array", "jsonPath": "$.pair", "values": [1, None]}, f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey % 3 = 1"),
    ("array_positional_both", ent_orders, {"type": "array", "jsonPath": "$.pair", "values": [1, 2]}, f"SELECT {_ORDER_ID} FROM orders WHERE o_custkey % 3 = 1 AND o_custkey % 5 = 2"),
    ("nested_group_or", ent_orders, both(both(lifecycle("state", "EQUALS", "F"), simple("total", "LESS_THAN", 50000)), simple("priority", "STARTS_WITH", "5"), operator="or"), f"SELECT {_ORDER_ID} FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR starts_with(o_orderpriority, '5')"),
)
for _name, _view, _condition, _sql in _LEAVES:
    query(_sql, _name)(lambda spark, sf_dir, v=_view, c=_condition: ids(v(spark, sf_dir), c))


@query(f"SELECT {_ORDER_ID} FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN o_custkey = 42 ELSE false END OR (o_orderkey % 2 = 1 AND o_custkey = 42)")
def poly_int_or_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that holds numbers in some documents and texts in others."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey") % 2 == 0
    doc = F.concat(F.lit('{"key":'), F.when(number, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"'))), F.lit("}"))
    return ids(EntityView(o.select(pad("o_orderkey").alias("id"), doc.alias("data")), declared(key=(D.LONG, D.STRING))), simple("key", "EQUALS", 42))


@query("SELECT o_orderstatus AS state, count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def count_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_by_state(ent_orders(spark, sf_dir), ["F", "O", "none"])


@query("SELECT count(*) AS count FROM orders")
def count_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(aggregate.count(ent_orders(spark, sf_dir)),)], "count long")


@query("SELECT o_orderstatus AS state, count(*) AS count, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) IS NULL AS none FROM orders GROUP BY 1")
def agg_absent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group without a number at the field has no average."""
    o = table(spark, sf_dir, "orders")
    view = entities(o, id=pad("o_orderkey"), state=F.col("o_orderstatus"), data={"total": F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))}, fields=declared(total=D.DOUBLE), promote=False)
    return aggregate.grouped(view, [aggregate.GroupExpr(is_state=True)], None, [aggregate.AggregateExpr("avg", "$.total", "mean")]).select("state", "count", F.col("mean").isNull().alias("none"))


@query("SELECT nullif(o_orderpriority, '1-URGENT') AS maybe, count(*) AS count, round(sum(o_totalprice), 2) AS sum_total FROM orders GROUP BY 1")
def group_by_path_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate.grouped(ent_orders(spark, sf_dir, promote=False), [aggregate.GroupExpr("$.maybe")], None, [aggregate.AggregateExpr("sum", "$.total")])
    return rows.select("maybe", "count", F.round("sum_total", 2).alias("sum_total"))


@query("SELECT l_returnflag AS state, l_linestatus AS status, count(*) AS count, min(l_quantity) AS min_quantity, max(l_quantity) AS max_quantity, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, round(stddev_samp(l_quantity), 5) AS spread FROM lineitem GROUP BY 1, 2")
def agg_min_max_sum_avg_stdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aggregate.AggregateExpr
    rows = aggregate.grouped(ent_lineitem(spark, sf_dir), [aggregate.GroupExpr(is_state=True), aggregate.GroupExpr("$.status")], None, [a("min", "$.quantity"), a("max", "$.quantity"), a("sum", "$.price"), a("avg", "$.discount"), a("stdev", "$.quantity", "spread")])
    return rows.select("state", "status", "count", "min_quantity", "max_quantity", F.round("sum_price", 2).alias("sum_price"), F.round("avg_discount", 6).alias("avg_discount"), F.round("spread", 5).alias("spread"))


@query("SELECT event_type AS state, count(*) AS count FROM events GROUP BY 1")
def group_cardinality_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate.grouped_bounded(ent_events(spark, sf_dir), [aggregate.GroupExpr(is_state=True)], 5)
    return spark.createDataFrame([(r.state, r["count"]) for r in rows], "state string, count long")


def _ranked(view: EntityView, *order: OrderSpec) -> DataFrame:
    return numbered(view, view.df, order).select((F.col("pos") + 1).alias("rn"), "id")


@query(f"SELECT row_number() OVER (ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS LAST, o_orderkey) AS rn, {_ORDER_ID} FROM orders")
def order_nulls_last_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ent_orders(spark, sf_dir), OrderSpec("maybe", desc=True))


@query(f"SELECT row_number() OVER (ORDER BY p_type, p_name DESC, p_partkey) AS rn, {_PART_ID} FROM part")
def order_text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ent_parts(spark, sf_dir), OrderSpec("type"), OrderSpec("name", desc=True))


@query(f"SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rn, {_PART_ID} FROM part")
def order_numeric_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ent_parts(spark, sf_dir), OrderSpec("size", desc=True, kind=OrderKind.NUMERIC))


@query(f"SELECT row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) AS rn, {_EVENT_ID} FROM events")
def order_temporal_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ent_events(spark, sf_dir), OrderSpec("creationDate", Source.META, kind=OrderKind.TEMPORAL))


@query(f"SELECT row_number() OVER (ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderkey) AS rn, {_ORDER_ID} FROM orders")
def order_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ent_tokens(spark, sf_dir), OrderSpec("urgent", desc=True, kind=OrderKind.BOOL))


@query("SELECT lpad(c_custkey::varchar, 12, '0') AS id, 'found' AS outcome FROM customer WHERE c_custkey BETWEEN 0 AND 99 UNION ALL SELECT NULL, 'limit exceeded'")
def search_bounded_at_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred customers with a limit of a hundred, which they fit, and with one of 99, which they exceed."""
    c = table(spark, sf_dir, "customer")
    view, condition = entities(c, id=pad("c_custkey"), data={"key": F.col("c_custkey")}, fields=declared(key=D.LONG)), json.dumps(simple("key", "LESS_THAN", 100))
    out = [(r.id, "found") for r in search.search_bounded(view, condition, 100)]
    try:
        out += [(r.id, "one too few") for r in search.search_bounded(view, condition, 99)]
    except SearchResultLimitExceededError:
        out.append((None, "limit exceeded"))
    return spark.createDataFrame(out, "id string, outcome string")


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as versions of an entity; a signup is a tombstone."""
    e = table(spark, sf_dir, "events")
    return e.select(pad("user_id").alias("id"), F.col("event_id").alias("version"), F.col("ts").alias("timestamp"), F.col("event_type").alias("state"), (F.col("event_type") == "signup").alias("deleted"), F.to_json(F.struct("value")).alias("data"))


_LAST = "SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS version FROM events {where} GROUP BY 1"


@query("SELECT lpad(user_id::varchar, 12, '0') AS id, version, state FROM (" + _LAST.format(where="WHERE ts <= timestamp '2024-01-15 00:00:00'") + ") WHERE state <> 'signup'")
def as_at_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.as_of(event_versions(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "version", "state")


@query("SELECT lpad(user_id::varchar, 12, '0') AS id, version, state FROM (" + _LAST.format(where="") + ") WHERE state <> 'signup'")
def current_excludes_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.as_of(event_versions(spark, sf_dir)).select("id", "version", "state")


@query("SELECT lpad(user_id::varchar, 12, '0') AS id, event_id AS version, event_type AS state, row_number() OVER (ORDER BY ts, event_id) AS nth FROM events WHERE user_id = 7")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of one entity, oldest first."""
    rows = search.history(event_versions(spark, sf_dir), "7".rjust(12, "0")).collect()
    return spark.createDataFrame([(r.id, r.version, r.state, k) for k, r in enumerate(rows, 1)], "id string, version long, state string, nth int")


@query(
    "SELECT id, state FROM (SELECT lpad(o_orderkey::varchar, 12, '0') AS id, CASE WHEN o_orderkey % 10 = 4 THEN 'staged' ELSE o_orderstatus END AS state, "
    "CASE WHEN o_orderkey % 10 = 4 THEN -o_orderkey ELSE o_totalprice END AS total FROM orders WHERE o_orderkey % 10 <> 3) WHERE total < 1500 ORDER BY total, id"
)
def merge_bounded_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed orders with changes over them, filtered, in order and within a limit."""
    view = ent_orders(spark, sf_dir, promote=False)
    key = F.col("id").cast("long")
    staged = view.df.where(key % 10 == 4).withColumn("state", F.lit("staged")).withColumn("data", F.format_string('{"total":%d}', -key))
    rows = search.merge_bounded(view, staged, view.df.where(key % 10 == 3), json.dumps(simple("total", "LESS_THAN", 1500)), 1_000_000, (OrderSpec("total", kind=OrderKind.NUMERIC),))
    return spark.createDataFrame([(r.id, r.state) for r in rows], "id string, state string")


@query(
    "SELECT lpad(o_orderkey::varchar, 12, '0') AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 NOT IN (3, 4) "
    "UNION ALL SELECT lpad(o_orderkey::varchar, 12, '0'), 'staged' FROM orders WHERE o_orderkey % 10 = 4"
)
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(pad("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), "o_orderkey")
    staged = rows.where("o_orderkey % 10 = 4").withColumn("state", F.lit("staged"))
    return search.merged(rows, staged, rows.where("o_orderkey % 10 = 3")).select("id", "state")


@query("SELECT 'k' AS key_id, 's' || length(c_mktsegment) || ':' || c_mktsegment AS segment, count(*) AS n_entities, lpad(min(c_custkey)::varchar, 12, '0') AS first_id FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1")
def unique_claims_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    view = entities(c, id=pad("c_custkey"), data={"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}, promote=False)
    made = unique.claims(view.df, [unique.UniqueKey("k", ("$.segment", "$.nation"))])
    return unique.violations(made).select("key_id", F.split("signature", unique.SEPARATOR)[0].alias("segment"), "n_entities", "first_id")


@query("SELECT count(*) AS claims, count(DISTINCT o_custkey % 50) AS signatures FROM orders")
def unique_claims_numeric_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal numbers in different notations are one signature."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_custkey") % 50
    text = F.when(F.col("o_orderkey") % 3 == 0, n.cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(n.cast("string"), F.lit(".0"))).otherwise(F.concat((n * 10).cast("string"), F.lit("e-1")))
    rows = o.select(pad("o_orderkey").alias("id"), F.concat(F.lit('{"n":'), text, F.lit("}")).alias("data"))
    made = unique.claims(rows, [unique.UniqueKey("k", ("$.n",))])
    return made.agg(F.count("signature").alias("claims"), F.count_distinct("signature").alias("signatures"))


def event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1000)
    return e.select(
        pad("event_id").alias("id"), at.alias("scheduled_time"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 1000 * 86_400_0).cast("long").alias("timeout_ms"),
        F.when(F.col("event_id") % 5 == 0, at + 86_400_000).alias("redispatch_after"), pad("user_id").alias("entity_id"), F.col("event_type").alias("source_state"),
    )


_NOW = 1_705_276_800_000  # 2024-01-15T00:00:00Z
_TASKS = (
    "(SELECT lpad(event_id::varchar, 12, '0') AS id, event_id, (epoch_us(ts) // 1000) AS scheduled_time, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 1000 * 864000 END AS timeout_ms, "
    "CASE WHEN event_id % 5 = 0 THEN (epoch_us(ts) // 1000) + 86400000 END AS redispatch_after, lpad(user_id::varchar, 12, '0') AS entity_id, event_type AS source_state FROM events)"
)


@query(f"SELECT id, scheduled_time FROM {_TASKS} WHERE scheduled_time <= {_NOW} AND (redispatch_after IS NULL OR redispatch_after <= {_NOW}) ORDER BY scheduled_time, id LIMIT 100")
def schedule_due_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.due(event_tasks(spark, sf_dir), _NOW).limit(100).select("id", "scheduled_time")


@query(f"SELECT id, CASE WHEN timeout_ms IS NULL OR {_NOW} - scheduled_time <= timeout_ms THEN 'FIRE' ELSE 'EXPIRE' END AS verdict FROM {_TASKS} WHERE scheduled_time <= {_NOW}")
def schedule_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_tasks(spark, sf_dir).where(F.col("scheduled_time") <= _NOW).select("id", schedule.lateness(_NOW).alias("verdict"))


@query(f"SELECT id FROM {_TASKS} WHERE NOT (entity_id = lpad('7', 12, '0') AND source_state <> 'purchase') AND event_id % 100 <> 1")
def schedule_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = event_tasks(spark, sf_dir)
    return schedule.reconciled(tasks, F.lit("7".rjust(12, "0")), F.lit("purchase"), cancel=tasks.where(F.col("id").cast("long") % 100 == 1)).select("id")


@query(f"SELECT pos, id FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, {_ORDER_ID} FROM orders WHERE o_orderstatus = 'F') WHERE pos BETWEEN 50 AND 149")
def async_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ent_orders(spark, sf_dir)
    found = numbered(view, search.filtered(view, json.dumps(lifecycle("state", "EQUALS", "F"))))
    return search.async_page(found.withColumn("job_id", F.lit("j")), "j", 50, 100).select("pos", "id")


@query(
    "SELECT kind, count(*) AS count FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'LOCAL_DATE' WHEN 1 THEN 'YEAR_MONTH' WHEN 2 THEN 'YEAR' WHEN 3 THEN 'LOCAL_DATE_TIME' WHEN 4 THEN 'ZONED_DATE_TIME' WHEN 5 THEN 'LOCAL_TIME' END AS kind FROM orders) GROUP BY 1"
)
def classify_temporal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    texts = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "HH:mm", "dd.MM.yyyy")]
    text = F.array(*texts)[(F.col("o_orderkey") % 7).cast("int")]
    return o.select(classify_temporal(text).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


@query(
    "SELECT role, actor, inside, CASE WHEN inside AND kind <> 'user' THEN 'origin' ELSE actor END AS attributed, actor AS executor, count(*) AS count "
    "FROM (SELECT role, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'service' ELSE 'system' END AS kind, role || '-' || turn AS actor, conv_id % 2 = 0 AS inside FROM conversations) GROUP BY ALL"
)
def attribution_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services act for the origin of the transaction that they are in, users for themselves: asked of the context for each kind of turn there is."""
    c = table(spark, sf_dir, "conversations")
    kinds = c.groupBy("role", "turn", (F.col("conv_id") % 2 == 0).alias("inside")).agg(F.count(F.lit(1)).alias("count")).collect()
    origin, out = context.Principal("origin", context.PrincipalKind.USER), []
    for r in kinds:
        kind = {"user": context.PrincipalKind.USER, "assistant": context.PrincipalKind.SERVICE}.get(r.role, context.PrincipalKind.SYSTEM)
        tx = Transaction("tx", "t", origin, 0) if r.inside else None
        with context.acting(context.UserContext(f"{r.role}-{r.turn}", "t", kind)), context.with_transaction(tx):
            attributed, executor = context.attribution()
        out.append((r.role, executor.id, r.inside, attributed.id, executor.id, r["count"]))
    return spark.createDataFrame(out, "role string, actor string, inside boolean, attributed string, executor string, count long")


@contextmanager
def _engine(spark: SparkSession, **options):
    """Stores in a folder of their own, which is removed afterwards."""
    path = scratch(spark, "engine")
    made = Engine(spark, path, **options)
    try:
        with context.acting(context.UserContext("u", "t")):
            yield made
    finally:
        made.close()
        remove(spark, path)


_STORED = ModelRef("customer")


@query(
    "SELECT lpad(c_custkey::varchar, 12, '0') AS id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE c_mktsegment END AS state, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED' ELSE 'CREATED' END AS change_type FROM customer WHERE c_custkey % 5 <> 0"
)
def store_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities saved in one commit; then a transaction with updates, deletions, and changes after a savepoint that it goes back to."""
    rows = table(spark, sf_dir, "customer").where("c_custkey is not null").select("c_custkey", pad("c_custkey").alias("id"), F.lit("{}").alias("data"), F.col("c_mktsegment").alias("state"))
    with _engine(spark) as made:
        s = made.entities
        s.save_table(_STORED, rows)
        tx = s.begin()
        with context.with_transaction(tx):
            s.save_table(_STORED, rows.where("c_custkey % 3 = 0").withColumn("state", F.lit("kept")))
            s.delete_table(rows.where("c_custkey % 5 = 0"))
            point = s.savepoint(tx.id)
            s.save_table(_STORED, rows.withColumn("state", F.lit("undone")))
            s.rollback_to(tx.id, point)
        s.commit(tx.id)
        return written(s.current(_STORED).select("id", "version", "state", "change_type"), "stored")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, lpad(c_custkey::varchar, 12, '0') AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def search_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asynchronous search of a store, read by pages of a tenth of its results."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").collect()
    with _engine(spark) as made:
        made.entities.save_all([Entity(str(r.c_custkey).rjust(12, "0"), _STORED, "{}", r.c_mktsegment) for r in rows])
        job = made.jobs.create(_STORED, json.dumps(lifecycle("state", "EQUALS", "BUILDING")))
        n, found = made.jobs.wait(job)["result_count"], []
        size = n // 10 + 1
        for at in range(0, n, size):
            found += made.jobs.page(job, at, size)[0]
    return spark.createDataFrame(list(enumerate(found)), "pos long, id string")


@query("SELECT r_name AS name, 'TYPE' AS change_level, CASE WHEN r_regionkey % 2 = 0 THEN 'LOCKED' ELSE 'UNLOCKED' END AS state, r_regionkey || '+' || (r_regionkey + 1) || '+' || (r_regionkey + 2) AS schema FROM region")
def models_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose schema is the saved one and its deltas, put together by the caller's function."""
    with _engine(spark, fold=lambda schema, deltas: "+".join([schema, *deltas])) as made:
        out = []
        for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
            model = ModelRef(r.r_name)
            made.models.save(model, str(r.r_regionkey), level=ChangeLevel.TYPE)
            for k in (1, 2):
                made.models.extend_schema(model, str(r.r_regionkey + k))
            if r.r_regionkey % 2 == 0:
                made.models.lock(model)
            got = made.models.get(model)
            out.append((r.r_name, got["change_level"], got["state"], got["schema"]))
    return spark.createDataFrame(out, "name string, change_level string, state string, schema string")


@query()
def fields_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"kind": "OBJECT", "children": {"items": {"kind": "ARRAY", "element": {"kind": "OBJECT", "types": ["LONG"], "children": {"id": {"kind": "LEAF", "types": ["UUID_TYPE"]}}}}, "name": {"kind": "LEAF", "types": ["STRING", "NULL"]}}}
    return spark.createDataFrame([(f.path, [t.name for t in f.types], f.is_array) for f in fields_map(json.dumps(tree)).values()], "path string, types array<string>, is_array boolean")


@query()
def parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, write_condition(parse_condition(json.dumps(c)))) for n, _, c, _ in _LEAVES]
    return spark.createDataFrame(rows, "name string, condition string")
