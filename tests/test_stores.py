"""Stores, transactions, search, schedules and jobs, against their contracts."""

import json
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fathomark import errors, queries
from fathomark.functions.datatypes import DataType as D
from fathomark.operators import aggregate, search, unique
from fathomark.operators.search import OrderKind, OrderSpec
from fathomark.plans.filters import Source
from fathomark.sources import context as cx
from fathomark.sources import log, registry, tables, workflow
from fathomark.sources.entities import EntityView, declared
from fathomark.sources.store import Entity, ModelRef
from fathomark.streaming.jobs import JobStore, numbered
from fathomark.streaming.schedule import ScheduledTask

M = ModelRef("order", "1")


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


@pytest.fixture
def engine(spark, tmp_path):
    e = tables.Engine(spark, "file://" + str(tmp_path / "store"), clock=Clock())
    with cx.acting(cx.UserContext("u", "t1")):
        yield e
    e.close()


def entity(i, state="new", **data):
    return Entity(i, M, json.dumps(data), state)


def test_versions_and_time(engine):
    s = engine.entities
    assert s.get_all(M) == [] and s.save(entity("a", n=1)) == 1
    first = s.clock.now
    assert s.save(entity("a", "done", n=2)) == 2 and s.get("a").state == "done"
    s.delete("a")
    assert not s.exists("a") and s.count(M) == 0
    with pytest.raises(errors.NotFoundError):
        s.delete("a")
    assert s.get("a", first).state == "new" and [r.id for r in s.get_all_as_at(M, first)] == ["a"] and s.get_all_as_at(M, first - timedelta(hours=1)) == []
    assert [(r.change_type, r.deleted) for r in s.history("a")] == [("CREATED", False), ("UPDATED", False), ("DELETED", True)]
    with cx.acting(cx.UserContext("x", "t2")):
        with pytest.raises(errors.NotFoundError):
            s.get("a", first)


def test_compare_and_save(engine):
    s = engine.entities
    s.save_all([entity("a"), entity("b", "ok")])
    tx = s.get("a").transaction_id
    assert s.compare_and_save(entity("a", "x"), tx) == 2
    with pytest.raises(errors.ConflictError):
        s.compare_and_save(entity("a", "y"), tx)
    assert s.count_by_state(M) == {"x": 1, "ok": 1} and s.count_by_state(M, []) == {} and s.count_by_state(M, ["ok", "none"]) == {"ok": 1}
    assert s.delete_all(M) == 2 and s.count(M) == 0


def test_transactions(engine):
    s = engine.entities
    s.save(entity("a", n=1))
    tx = s.begin()
    with cx.with_transaction(tx):
        s.save(entity("b", n=2))
        s.save(entity("a", "changed", n=1))
        assert {r.id: r.state for r in s.get_all(M)} == {"a": "changed", "b": "new"} and s.get("b").id == "b"
        point = s.savepoint(tx.id)
        s.save(entity("c"))
        s.delete("a")
        assert [r.id for r in s.get_all(M)] == ["b", "c"]
        s.rollback_to(tx.id, point)
        assert [r.id for r in s.get_all(M)] == ["a", "b"]
        with pytest.raises(errors.SavepointNotFoundError):
            s.release(tx.id, "none")
        s.release(tx.id, point)
    assert [r.id for r in s.get_all(M)] == ["a"]
    before = s.clock.now
    s.commit(tx.id)
    assert {r.id: r.state for r in s.get_all(M)} == {"a": "changed", "b": "new"} and s.submit_time(tx.id) > before
    for work in (s.commit, s.join, s.rollback):
        with pytest.raises(errors.TxAlreadyCommittedError):
            work(tx.id)
    gone = s.begin()
    s.rollback(gone.id)
    with pytest.raises(errors.TxRolledBackError), cx.with_transaction(gone):
        s.save(entity("z"))
    with pytest.raises(errors.TxNotFoundError):
        s.commit("none")
    other = s.begin()
    with cx.acting(cx.UserContext("x", "t2")), pytest.raises(errors.TxTenantMismatchError):
        s.join(other.id)


def test_first_committer_wins(engine):
    s = engine.entities
    s.save(entity("a"))
    one, two = s.begin(), s.begin()
    for tx in (one, two):
        with cx.with_transaction(tx):
            s.save(entity("a", tx.id))
    s.commit(one.id)
    with pytest.raises(errors.ConflictError):
        s.commit(two.id)
    assert s.get("a").state == one.id


def test_attribution(engine):
    s = engine.entities
    with cx.with_ambient_origin(cx.Principal("clock", cx.PrincipalKind.SYSTEM)):
        assert s.begin().origin == cx.Principal("clock", cx.PrincipalKind.SYSTEM)
    tx = s.begin()
    with cx.acting(cx.UserContext("svc", "t1", cx.PrincipalKind.SERVICE)), cx.with_transaction(s.join(tx.id)):
        s.save(entity("a"))
    s.commit(tx.id)
    row = s.get("a")
    assert (row.change_user, row.change_user_kind, row.change_executor) == ("u", "user", "svc") and tx.origin.id == "u"
    assert cx.must_user().has_role("x") is False


def test_unique_keys(engine):
    s, keys = engine.entities, [unique.UniqueKey("k", ("$.a", "$.b.c"))]
    s.save(Entity("1", M, '{"a":42,"b":{"c":"x"}}'), keys)
    with pytest.raises(errors.UniqueViolationError):
        s.save(Entity("2", M, '{"a":4.20e1,"b":{"c":"x"}}'), keys)
    with pytest.raises(errors.PartialUniqueKeyError):
        s.save(Entity("3", M, '{"a":42}'), keys)
    s.save(Entity("4", M, "{}"), keys)
    s.delete("1")
    s.save(Entity("2", M, '{"a":42.0,"b":{"c":"x"}}'), keys)
    assert s.count(M) == 2


@pytest.mark.parametrize(("a", "b", "same"), [("42", "42.0", True), ("0", "-0", True), ("1e2", "100", True), ("9007199254740993", "9007199254740992", False), ("0.1", "1e-1", True), ("-5", "5", False)])
def test_canonical_numbers(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(unique.canonical_number(F.col("a")).alias("a"), unique.canonical_number(F.col("b")).alias("b")).first()
    assert (row.a == row.b) == same


def test_search_bounded(engine):
    s = engine.entities
    s.save_all([entity(str(i), n=i, status="match" if i % 2 else "no") for i in range(7)])
    fields, condition = declared(status=D.STRING, n=D.INTEGER), json.dumps({"type": "simple", "jsonPath": "$.status", "operator": "EQUALS", "value": "match"})
    assert [r.id for r in s.search(M, condition, fields=fields, limit=3)] == ["1", "3", "5"]
    assert [r.id for r in s.search(M, condition, fields=fields, order=[OrderSpec("n", desc=True, kind=OrderKind.NUMERIC)])] == ["5", "3", "1"]
    with pytest.raises(errors.SearchResultLimitExceededError):
        s.search(M, condition, fields=fields, limit=2)
    tx = s.begin()
    with cx.with_transaction(tx):
        s.save(entity("9", status="match"))
        assert len(s.search(M, condition, fields=fields, tracking=True)) == 4 and tx.read == {"1", "3", "5", "9"}
    view = s.view(M, fields)
    assert len(list(search.iterate(view, condition))) == 3
    with pytest.raises(errors.ScanBudgetExhaustedError):
        list(search.iterate(view, condition, budget=3))


def test_order(spark):
    rows = [("a", '{"n":2,"t":"b","f":true}', "x"), ("b", '{"n":"10","t":null}', ""), ("c", "{}", "y"), ("d", '{"n":2,"t":{"k":1},"f":false}', "x")]
    view = EntityView(spark.createDataFrame(rows, "id string, data string, state string"))
    ids = lambda *o: [r.id for r in search.search(view, None, o).collect()]
    assert ids(OrderSpec("n", kind=OrderKind.NUMERIC)) == ["a", "d", "b", "c"] and ids(OrderSpec("n", desc=True, kind=OrderKind.NUMERIC)) == ["b", "a", "d", "c"]
    assert ids(OrderSpec("t")) == ["a", "d", "b", "c"] and ids(OrderSpec("f", kind=OrderKind.BOOL)) == ["d", "a", "b", "c"]
    assert ids(OrderSpec("state", Source.META, desc=True)) == ["c", "a", "d", "b"]
    assert [r.id for r in numbered(view, view.df, (OrderSpec("state", Source.META, desc=True),)).orderBy("pos").collect()] == ["c", "a", "d", "b"]
    assert search.classify_order([D.NULL, D.INTEGER, D.DOUBLE]) is OrderKind.NUMERIC and search.classify_order([D.YEAR], fold_temporal=True) is OrderKind.TEXT
    for bad in ([], [D.INTEGER, D.STRING], [D.BYTE_ARRAY]):
        with pytest.raises(ValueError):
            search.classify_order(bad)
    assert search.resolve_meta_field("creationDate").kind is OrderKind.TEMPORAL and len(search.meta_field_names()) == 6
    with pytest.raises(ValueError):
        search.resolve_meta_field("nested.name")


def test_grouped(spark):
    rows = [("1", '{"k":"a","v":1}', "s"), ("2", '{"k":"a","v":"9"}', "s"), ("3", '{"k":null,"v":3}', "s"), ("4", '{"k":{"x":1},"v":5}', "q"), ("5", '{"v":7}', "q"), ("6", '{"k":30.0}', "q")]
    view = EntityView(spark.createDataFrame(rows, "id string, data string, state string"))
    a = aggregate.AggregateExpr
    got = {r.k: r for r in aggregate.grouped_bounded(view, [aggregate.GroupExpr("$.k")], 3, None, [a("sum", "$.v"), a("stdev", "$.v", "sd"), a("avg", "$.v", " ")])}
    assert {k: r["count"] for k, r in got.items()} == {"a": 2, None: 3, "30": 1}
    assert got["a"].sum_v == 1 and got["a"].sd is None and got[None].sum_v == 15 and got[None].sd == 2.0 and got["30"].sum_v is None and got[None].avg_v == 5
    with pytest.raises(errors.GroupCardinalityExceededError):
        aggregate.grouped_bounded(view, [aggregate.GroupExpr("$.k")], 2)
    with pytest.raises(ValueError):
        aggregate.grouped_bounded(view, [], 0)
    assert {r.state: r["count"] for r in aggregate.count_by_state(view, ["s"]).collect()} == {"s": 3} and aggregate.count(view) == 6


def test_small_stores(engine):
    kv = engine.key_values
    kv.put("n", "k", b"\x00\xff")
    kv.put("n", "k", b"2")
    kv.put("n", "b", b"3")
    assert kv.get("n", "k") == b"2" and kv.list("n") == {"b": b"3", "k": b"2"} and kv.list("m") == {}
    kv.delete("n", "k")
    with pytest.raises(errors.NotFoundError):
        kv.get("n", "k")
    big = bytes(range(256)) * 16384
    for i in ("1", "2", "3"):
        engine.messages.save(tables.Message(i, tables.MessageHeader(subject="s"), big, {"a": 1}))
    got = engine.messages.get("1")
    assert got.payload == big and got.header.subject == "s" and got.values == {"a": 1}
    engine.messages.delete_batch(["1", "2"])
    for i in ("1", "2"):
        with pytest.raises(errors.NotFoundError):
            engine.messages.get(i)
    assert engine.messages.get("3").id == "3"
    engine.workflows.save(M, [{"name": "w"}])
    engine.workflows.save(M, [{"name": "v"}])
    assert engine.workflows.get(M) == [{"name": "v"}]
    engine.workflows.delete(M)
    assert engine.workflows.get(M) == []
    engine.audit.record({"entity_id": "e", "event_type": "A", "transaction_id": "1"}, {"entity_id": "e", "event_type": "B", "transaction_id": "2"})
    engine.audit.record({"entity_id": "e", "event_type": "C", "transaction_id": "1"})
    assert [r.event_type for r in engine.audit.events("e")] == ["A", "B", "C"] and [r.event_type for r in engine.audit.events_by_transaction("e", "1")] == ["A", "C"] and engine.audit.events("x") == []


def test_models(engine):
    m = engine.models
    schema = json.dumps({"kind": "OBJECT", "children": {"a": {"kind": "LEAF", "types": ["LONG"]}}})
    m.save(M, schema, keys=[unique.UniqueKey("k", ("$.a",))])
    m.lock(M)
    m.lock(M)
    assert m.is_locked(M) and m.get(M)["unique_keys"][0].id == "k" and m.fields(M)["$.a"].types == (D.LONG,) and m.all() == [M]
    m.unlock(M)
    m.set_change_level(M, tables.validate_change_level("TYPE"))
    m.extend_schema(M, None)
    assert not m.is_locked(M) and m.get(M)["change_level"] == "TYPE" and m.get(M)["schema"] == schema
    m.extend_schema(M, schema.replace("LONG", "STRING"))
    assert m.fields(M)["$.a"].types == (D.STRING,) and tables.validate_change_level("") is None
    m.delete(M)
    with pytest.raises(errors.NotFoundError):
        m.delete(M)
    with pytest.raises(ValueError):
        tables.validate_change_level("NOPE")


def test_registry(spark, tmp_path):
    assert registry.plugin_names() == ["parquet"]
    with pytest.raises(ValueError):
        registry.register(registry.plugin("parquet"))
    with pytest.raises(errors.NotFoundError):
        registry.plugin("none")
    with pytest.raises(ValueError):
        registry.plugin("parquet").open({}, spark)
    line = registry.LocalBroadcaster()
    got = []
    line.subscribe("t", lambda _: 1 / 0)
    line.subscribe("t", got.append)
    engine = registry.plugin("parquet").open({"path": "file://" + str(tmp_path)}, spark, broadcaster=line)
    engine.broadcaster.broadcast("t", b"x")
    assert got == [b"x"] and isinstance(engine, tables.Engine)
    engine.close()


def test_workflows():
    wire = {
        "version": "1", "name": "w", "initialState": "s", "active": True, "annotations": {"any": [1]},
        "states": {"s": {"transitions": [{"name": "t", "next": "e", "manual": False, "processors": [{"type": "x", "name": "p", "config": {"asyncResult": False}}], "schedule": {"delayMs": 0, "function": {"name": "f", "resultKind": "Schedule", "calculationNodesTags": "", "attachEntity": True}}}]}, "e": {}},
    }
    w = workflow.WorkflowDefinition.from_wire(wire)
    assert w.to_wire() == wire and w.states["s"].transitions[0].processors[0].config.start_new_tx_on_dispatch is None
    w.states["s"].transitions[0].schedule.validate()
    with pytest.raises(ValueError):
        workflow.TransitionSchedule(5, function=workflow.ScheduleFunction("f")).validate()
    assert len(workflow.EventType) == 17
    e = workflow.StateMachineEvent(workflow.EventType.CANCELLED, "e", "u", details="d", timestamp=datetime(2024, 1, 1))
    assert workflow.StateMachineEvent.from_wire(e.to_wire()) == e and "state" not in e.to_wire()


def test_scheduled_tasks(engine):
    t = engine.tasks
    task = lambda i, at, **k: ScheduledTask(i, k.pop("tenant", "t1"), at, entity_id="e", source_state=k.pop("state", "s"), **k)
    t.upsert(task("1", 100), task("2", 50, tenant="t2"), task("3", 999))
    assert [x.id for x in t.scan_due(100, 10)] == ["2", "1"] and [x.id for x in t.scan_due(100, 1)] == ["2"]
    t.mark_redispatch("1", 200)
    assert [x.id for x in t.scan_due(150, 10)] == ["2"] and t.get("1").attempt_count == 1 and [x.id for x in t.scan_due(200, 10)] == ["2", "1"]
    t.upsert(task("1", 70))
    assert t.get("1").redispatch_after is None and t.get("1").attempt_count == 0
    assert t.delete("2") and not t.delete("2") and t.get("2") is None
    gone = t.reconcile("t1", "e", "next", arm=[task("9", 5, state="next")], cancel=["3", "none"])
    assert sorted(x.id for x in gone) == ["1", "3"] and t.get("9").source_state == "next"
    assert t.get("1") is None and t.get("3") is None


def test_search_jobs(engine):
    s = engine.entities
    s.save_all([entity(f"{i:02d}", n=i) for i in range(12)])
    job = engine.jobs.create(M, json.dumps({"type": "simple", "jsonPath": "$.n", "operator": "LESS_THAN", "value": 10}), fields=declared(n=D.INTEGER))
    assert engine.jobs.wait(job)["status"] == "SUCCESSFUL"
    assert engine.jobs.page(job, 8, 5) == (["08", "09"], 10) and engine.jobs.page(job, 0, 2)[0] == ["00", "01"] and not engine.jobs.cancel(job)
    assert engine.jobs.reap(datetime.now(timezone.utc) + timedelta(hours=1)) == 1
    with pytest.raises(errors.NotFoundError):
        engine.jobs.job(job)


def test_jobs_that_others_execute(engine, spark):
    own = JobStore(spark, engine.jobs.path + "/plain")
    assert engine.jobs.self_executing and not own.self_executing
    at = datetime(2024, 3, 4, tzinfo=timezone.utc)
    first, second = own.create_job(M, "{}", at=at, options='{"limit":7}'), own.create_job(M, "{}")
    made = own.job(first)
    assert (made["status"], made["model_name"], made["options"], made["finish_time"]) == ("RUNNING", M.name, '{"limit":7}', None)
    assert own.page(first, 0, 5) == ([], 0)
    own.save_results(first, ["c", "a", "b"])
    own.save_results(second, spark.createDataFrame([(1, "y"), (0, "x")], "pos long, entity_id string"))
    own.update_status(first, "SUCCESSFUL", result_count=3, calc_time_ms=12)
    assert own.page(first, 1, 9) == (["a", "b"], 3) and own.page(second, 0, 9) == (["x", "y"], 2)
    assert own.job(first)["calc_time_ms"] == 12 and own.job(first)["finish_time"] is not None
    own.update_status(second, "FAILED", error="no shard")
    assert own.job(second)["error"] == "no shard" and not own.cancel(second)
    with cx.acting(cx.UserContext("v", "t2")):
        for ask in (own.job, own.cancel, own.delete, lambda i: own.page(i, 0, 1), lambda i: own.save_results(i, ["z"]), lambda i: own.update_status(i, "FAILED")):
            with pytest.raises(errors.NotFoundError):
                ask(first)
    own.delete(first)
    with pytest.raises(errors.NotFoundError):
        own.job(first)
    assert own.results.read().select("job_id").distinct().collect() == [(second,)]


def test_job_of_a_point_in_time(engine):
    s = engine.entities
    s.save(entity("old", n=1))
    at = s.get("old").timestamp.astimezone(timezone.utc)
    s.save(entity("new", n=1))
    every = '{"type":"group","operator":"AND","conditions":[]}'
    then, now = engine.jobs.create(M, every, at=at), engine.jobs.create(M, every)
    assert engine.jobs.wait(then)["result_count"] == 1 and engine.jobs.wait(now)["result_count"] == 2
    assert engine.jobs.page(then, 0, 9) == (["old"], 1)


def test_one_view_many_threads(spark):
    view = EntityView(spark.createDataFrame([(str(i), f'{{"n":{i}}}') for i in range(20)], "id string, data string"), declared(n=D.INTEGER))
    out = []

    def work(k):
        out.append((k, search.filtered(view, json.dumps({"type": "simple", "jsonPath": "$.n", "operator": "LESS_THAN", "value": k})).count()))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out) == [(k, k) for k in range(8)]


def jobs_of(spark, work):
    scheduler = spark._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    work()
    return scheduler.numTotalJobs() - before


def test_many_entities_in_a_few_jobs(engine, spark):
    s = engine.entities
    few = jobs_of(spark, lambda: s.save_all([entity(f"a{k}", n=k) for k in range(3)]))
    many = jobs_of(spark, lambda: s.save_all([entity(f"b{k:05}", n=k) for k in range(10_000)]))
    assert many <= few + 4, (few, many)
    assert s.count(M) == 10_003 and s.save_all([entity("a0", n=9), entity("a0", n=10), entity("new")]) == [2, 2, 1]
    assert json.loads(s.get("a0").data) == {"n": 10}
    assert jobs_of(spark, lambda: s.delete_all(M)) < 15 and s.count(M) == 0
    assert [(r.version, r.change_type, r.change_user) for r in s.history("a0")] == [(1, "CREATED", "u"), (2, "UPDATED", "u"), (3, "DELETED", "u")]
    s.save_all([entity("c1"), entity("c2")])
    tx = s.begin()
    with cx.with_transaction(tx):
        s.save(entity("c3"))
        assert s.delete_all(M) == 3 and s.get_all(M) == []
    assert s.count(M) == 2
    s.commit(tx.id)
    assert s.count(M) == 0


def test_racing_writers(spark, tmp_path):
    """Two at a time create the same log entry: one of them wins, and each row is there once."""
    own = [log.LogTable(spark, f"file://{tmp_path}/t", "who string, n long") for _ in range(2)]
    gate, won = threading.Barrier(8), []

    def create(k):
        gate.wait()
        for n in range(1, 40):
            if own[k % 2]._create(f"{n:012d}", f"data/_folder={k}-{n}"):
                won.append((n, k))

    threads = [threading.Thread(target=create, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in won) == list(range(1, 40)) and len(own[0].entries()) == 39
    assert all(own[0]._folder(f"{n:012d}.json") == f"data/_folder={k}-{n}" for n, k in won)
    table = log.LogTable(spark, f"file://{tmp_path}/u", "who string, n long")
    threads = [threading.Thread(target=lambda k=k: [table.append([{"who": f"w{k}", "n": n}]) for n in range(5)]) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert table.read().count() == 15 and sorted(k for k, _ in table.entries()) == list(range(1, 16))
    with pytest.raises(errors.ConflictError):
        table.append([{"who": "late", "n": 0}], after=3)


def test_compaction(spark, tmp_path):
    table = log.LogTable(spark, f"file://{tmp_path}/t", "k string, part string, n long", partition_by=("part",))
    for n in range(6):
        table.append([{"k": "a", "part": "x", "n": n}, {"k": f"b{n}", "part": "y", "n": n}])
    rows = lambda **r: sorted((x["_commit"], x["_pos"], x.k, x.part, x.n) for x in table.read(**r).collect())
    before, middle = rows(), rows(since=2, until=4)
    assert table.compact() == 6 and table.compact() == 6 and rows() == before and rows(since=2, until=4) == middle and rows(since=4) == [r for r in before if r[0] > 4]
    table.append([{"k": "a", "part": "x", "n": 99}])
    assert table.snapshot() == 7 and [r.n for r in table.latest(["k"]).where("k = 'a'").collect()] == [99]
    assert table.compact(vacuum=True) == 7 and table.entries() == [] and len(rows()) == 13 and table.append([{"k": "z", "part": "x", "n": 1}]) == 8
    assert "PartitionFilters: [isnotnull(part" in table.read().where("part = 'x'")._jdf.queryExecution().executedPlan().toString().replace("`", "")


def test_versions_are_read_by_tenant_and_model(engine):
    engine.entities.save(entity("a"))
    plan = engine.entities.current(M)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "model_name" in plan.split("PartitionFilters")[1].split("]")[0]


def test_merge_bounded(spark):
    committed = spark.createDataFrame([(f"{k:03}", f'{{"n":{k}}}') for k in range(500)], "id string, data string").repartition(5)
    view = EntityView(committed, declared(n=D.INTEGER))
    staged = spark.createDataFrame([("100", '{"n":-1}'), ("zzz", '{"n":3}')], "id string, data string")
    deleted = spark.createDataFrame([("002",)], "id string")
    order = (OrderSpec("n", kind=OrderKind.NUMERIC),)
    low = '{"type":"simple","jsonPath":"$.n","operatorType":"LESS_THAN","value":5}'
    assert [r.id for r in search.merge_bounded(view, staged, deleted, low, 10, order)] == ["100", "000", "001", "003", "zzz", "004"]
    with pytest.raises(errors.SearchResultLimitExceededError):
        search.merge_bounded(view, staged, deleted, None, 100, order)
    top = search.search(view.over(search.merged(view.df, staged, deleted)), None, order).limit(101)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_declined_aggregates(spark):
    view = EntityView(spark.createDataFrame([("1", '{"n":1}', "s")], "id string, data string, state string"), declared(n=D.INTEGER))
    state = [aggregate.GroupExpr(is_state=True)]
    for groups, made in ((state, [aggregate.AggregateExpr("median", "$.n")]), (state, [aggregate.AggregateExpr("sum", "$.items[*].n")]), ([aggregate.GroupExpr("$.items[*].n")], [])):
        with pytest.raises(errors.AggregationNotPushdownableError):
            aggregate.grouped(view, groups, None, made)
    assert [r.id for r in search.iterate(view)] == ["1"]


def test_models_fold_by_a_function(spark, tmp_path):
    e = tables.Engine(spark, f"file://{tmp_path}/m", fold=lambda schema, deltas: "+".join([schema, *deltas]))
    with cx.acting(cx.UserContext("u", "t1")):
        e.models.save(M, "s")
        e.models.extend_schema(M, "a")
        e.models.extend_schema(M, "b")
        assert e.models.get(M)["schema"] == "s+a+b"
    e.close()


def test_results_go_with_their_jobs(engine):
    engine.entities.save_all([entity(f"j{k}", n=k) for k in range(5)])
    first, second = (engine.jobs.create(M, '{"type":"group","operator":"AND","conditions":[]}') for _ in range(2))
    assert engine.jobs.wait(first)["result_count"] == engine.jobs.wait(second)["result_count"] == 5
    assert engine.jobs.page(second, 1, 2) == (["j1", "j2"], 5)
    engine.jobs.table.append([engine.jobs.job(first) | {"finish_time": datetime(2020, 1, 1, tzinfo=timezone.utc)}])
    assert engine.jobs.reap(datetime(2021, 1, 1, tzinfo=timezone.utc)) == 1
    assert {r.job_id for r in engine.jobs.results.read().collect()} == {second} and engine.jobs.page(second, 4, 9) == (["j4"], 5)
    with pytest.raises(errors.NotFoundError):
        engine.jobs.job(first)


def test_scratch_is_cleared(spark):
    import os

    from fathomark.sources import shared

    with shared.clearing(spark):
        kept = shared.scratch(spark, "outer")
        with shared.clearing(spark):
            df = shared.written(spark.range(5).toDF("n"), "inner")
            assert df.count() == 5
            inner = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert not os.path.exists(inner) and spark.range(1).write.parquet(kept) is None and os.path.exists(kept.removeprefix("file://"))
    assert not os.path.exists(kept.removeprefix("file://"))


def _transaction(spark, s, tables):
    """What a transaction shows and leaves, its writes made from DataFrames or from lists."""
    frame = lambda ids, state: spark.createDataFrame([(i, f'{{"n": "{i}"}}', state) for i in ids], "id string, data string, state string")
    listed = lambda ids, state: s.save_all([entity(i, state, n=i) for i in ids])
    save = (lambda ids, state: s.save_table(M, frame(ids, state))) if tables else listed
    delete = (lambda ids: s.delete_table(frame(ids, ""))) if tables else s.delete_ids
    save("abcde", "old")
    s.delete_ids(["d", "e"])
    tx, seen = s.begin(), []
    look = lambda: seen.append([(r.id, r.version, r.state, r.change_type, r.data) for r in s.get_all(M)])
    with cx.with_transaction(tx):
        listed("ap", "listed")
        save("abxy", "one")
        look()
        s.delete_ids(["x", "a"])
        assert not s.exists("x") and s.get("b").state == "one" and s.get("c").state == "old"
        look()
        save("xd", "two")
        delete("yb")
        look()
        listed("yzc", "three")
        point = s.savepoint(tx.id)
        save("abcxyz", "undone")
        delete("ap")
        look()
        s.rollback_to(tx.id, point)
        for gone in ("a", "e", "never"):
            with pytest.raises(errors.NotFoundError):
                delete([*"c", gone])
        look()
        seen.append(s.count_by_state(M))
    s.commit(tx.id)
    look()
    kept = s.versions().where(F.col("transaction_id") == tx.id).orderBy("id").collect()
    return seen, [(r.id, r.version, r.state, r.change_type, r.deleted, r.data, r.change_user, r.creation_date == s.submit_time(tx.id).replace(tzinfo=None), r.last_update == r.timestamp) for r in kept]


def test_transactions_of_tables(spark, tmp_path):
    made = []
    for tables_ in (False, True):
        e = tables.Engine(spark, f"file://{tmp_path}/{tables_}", clock=Clock())
        with cx.acting(cx.UserContext("u", "t1")):
            made.append(_transaction(spark, e.entities, tables_))
        e.close()
    assert made[0] == made[1] and len(made[0][1]) > 5
    assert not any((tmp_path / "True/staged").iterdir())


def test_tables_refused(engine, spark):
    s, keys = engine.entities, [unique.UniqueKey("k", ("$.a",))]
    for ids, told in ((["a", "a"], "comes twice"), (["a", None], "no id")):
        with pytest.raises(ValueError, match=told):
            s.save_table(M, spark.createDataFrame([(i, "{}") for i in ids], "id string, data string"))
    one = spark.createDataFrame([("1", '{"a":1}'), ("2", '{"a":1.0}')], "id string, data string")
    with pytest.raises(errors.UniqueViolationError):
        s.save_table(M, one, keys)
    assert s.count(M) == 0 and s.save_table(M, one.where("id = '1'"), keys) == 1
    one_, two = s.begin(), s.begin()
    for tx in (one_, two):
        with cx.with_transaction(tx):
            assert s.save_table(M, one.where("id = '1'")) == 1 and s.delete_all(M) == 1
    s.commit(one_.id)
    with pytest.raises(errors.ConflictError):
        s.commit(two.id)


def test_rows_of_a_stored_table_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """No list that passes the driver, either way, is as long as the table."""
    spark.range(500).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    kind, session = type(spark.range(1)), type(spark)
    longest, collect, create = [0], kind.collect, session.createDataFrame

    def collected(df):
        rows = collect(df)
        longest[0] = max(longest[0], len(rows))
        return rows

    def created(self, data, *args, **kwargs):
        longest[0] = max(longest[0], len(data) if isinstance(data, list) else 0)
        return create(self, data, *args, **kwargs)

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(session, "createDataFrame", created)
    got = queries.QUERIES["store_transaction"](spark, str(tmp_path))
    assert longest[0] < 50
    monkeypatch.undo()
    assert got.count() == 400 and {tuple(r) for r in got.groupBy("version", "state", "change_type").count().collect()} == {(1, "BUILDING", "CREATED", 267), (2, "kept", "UPDATED", 133)}
