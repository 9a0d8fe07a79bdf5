"""Each stage of the pipeline on the rows that break things."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm import brute
from tests.llm.conftest import prose

pytest.importorskip("public_tokenizers")
CLASHING = "lang string, n_words string, kept string, component_id string, n_removed string, contaminated string, key string, n_chars long"
FIRST_FOUR, LAST = cp.STAGES[:-1], cp.STAGES[-1][1]


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(1)
    items = [("i1", prose(rng, 15)), (None, prose(rng, 12)), ("i3", None), ("i4", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", items


@pytest.fixture
def docs(spark, sf_dir):
    rng = random.Random(2)
    a, b, passage = prose(rng, 60), prose(rng, 70), prose(rng, 30)
    texts = [(1, a), (1, a), (1, b), (None, a), (None, None), (2, a + " end"), (3, None), (3, None), (4, ""), (5, " \n "), (6, f"{prose(rng, 30)} {passage}"), (7, f"{passage} {prose(rng, 30)}"), (8, passage), (9, sf_dir[1][0][1] + " " + prose(rng, 25)), (10, prose(rng, 25) + " " + sf_dir[1][1][1]), (11, prose(rng, 40_000))]
    rows = [(d, t, f"l{k}", "w", "k", "c", "r", "x", "y", len(t or "")) for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def own(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_empty_tables(spark, docs, sf_dir):
    none = docs.limit(0)
    for _, stage in FIRST_FOUR:
        out = stage(spark, none, sf_dir[0])
        assert out.columns == docs.columns and out.count() == 0
    assert LAST(spark, none, sf_dir[0]).count() == 0


def test_columns_pass_through(spark, docs, sf_dir):
    every = {(r.doc_id, r.text, r.lang): tuple(r) for r in docs.collect()}
    for name, stage in FIRST_FOUR:
        out = stage(spark, docs, sf_dir[0])
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        for r in out.collect():
            assert (r.n_words, r.kept, r.component_id, r.n_removed, r.contaminated, r.key) == ("w", "k", "c", "r", "x", "y")
            assert name == "substring dedup" or every[r.doc_id, r.text, r.lang] == tuple(r)
    last = LAST(spark, docs, sf_dir[0])
    assert last.columns[: len(docs.columns)] == docs.columns and all(r.roundtrip for r in last.collect()) and last.count() == docs.count()


def test_quality_stage(spark, docs, sf_dir):
    got = own(cp.quality_rules(spark, docs, sf_dir[0]))
    assert got == sorted(((r.doc_id, r.text) for r in docs.collect() if not brute.quality(r.text)[5]), key=repr) and (1, docs.where("doc_id = 1").first().text) in got and not any(t in (None, "", " \n ") for _, t in got)


def test_near_duplicate_stage(spark, docs, sf_dir):
    out = cp.near_duplicates(spark, docs, sf_dir[0])
    got = own(out)
    # of all rows with the text of doc 1, or nearly, the one without an id comes first; null and wordless texts stay, once each
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    a = next(t for d, t in texts if d is None and t)
    want = {(d, t) for d, t in texts if not t or t != a and not t.startswith(a)} | {(None, a)}
    assert got == sorted(want, key=repr)
    assert out.where("doc_id = 3").first().lang == "l6"


def test_substring_stage(spark, docs, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cut = brute.substring_dedup(rows)
    got = cp.substring_dedup(spark, docs, sf_dir[0]).collect()
    stay = [(d, t) for d, t in rows if cut[d, t][1] == 0 or cut[d, t][1] < cut[d, t][0]]
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in stay), key=repr)
    assert all(r.n_chars == len(r.text or "") for r in got) and not any(r.doc_id == 8 for r in got)
    assert {r.text for r in got if r.doc_id in (3, 4, 5)} == {None, "", " \n "}
    bare = cp.substring_dedup(spark, docs.select("doc_id", "text"), sf_dir[0])
    assert bare.columns == ["doc_id", "text"] and bare.count() == len(got)


def test_decontamination_stage(spark, docs, sf_dir):
    got = own(cp.benchmark_decontamination(spark, docs, sf_dir[0]))
    assert got == sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (9, 10)), key=repr)


def test_repeated_rows_are_alike(spark, docs, sf_dir):
    twice = docs.unionAll(docs)
    for k, (_, stage) in enumerate(FIRST_FOUR):
        once, both = rows_of(stage(spark, docs, sf_dir[0])), rows_of(stage(spark, twice, sf_dir[0]))
        assert both == (once if k == 1 else sorted(once * 2, key=repr))


def test_run_leaves_one_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    import os

    from fathomark.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert cp.run(spark, f"file://{tmp_path}").count() > 0
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["benchmark"]
