"""The registered queries and the pipeline, on the smallest tables."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from fathomark.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    assert [int(n.split("_")[0][2:]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracles(spark, name):
    con = duckdb.connect()
    # the smallest table has too few urls for rules
    sf = SF.replace("0.001", "0.01") if name == "url_mined_rules" else SF
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    rows = sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
    got = queries.QUERIES[name](spark, sf)
    assert rows and sorted(got.columns) == columns and sorted(tuple(r[c] for c in columns) for r in got.collect()) == rows


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    known = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(got) == docs.count() and len(known) > 200 and sum(r.lang == r.lang_pred for r in known) >= 0.97 * len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from fathomark.llm import quality

    rows = {r.doc_id: r.text for r in quality.apply_policy(quality.ledger(docs), "web-1").where("kept").collect()}
    rows = {d: rows[d] for d, (_, c) in brute.jaccard(rows.items(), 5, 80).items() if c == d}
    seen, cut = set(), {}
    for d in sorted(rows):
        w = brute.plain(rows[d])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if (k := tuple(w[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        if not all(gone) or not w:
            cut[d] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else rows[d]
    clean = {d: t for d, t in cut.items() if not brute.decontaminate([(d, t)], items)[d, t][4]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == clean and all(r.roundtrip and r.n_tokens == len(r.ids) for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id])
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
