"""The registered queries against their SQL, and a stream."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fathomark import queries
from fathomark.functions.datatypes import DataType as D
from fathomark.sources.entities import EntityView, declared
from fathomark.streaming.jobs import matching_stream

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())


def test_entry(spark):
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    spark.range(20).select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(F.col("id").alias("n"))).alias("data")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, data string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    view = EntityView(spark.createDataFrame([], "id string, data string"), declared(n=D.INTEGER))
    found = matching_stream(stream, view, '{"type":"simple","jsonPath":"$.n","operatorType":"GREATER_OR_EQUAL","value":15}')
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(int(r.id) for r in spark.sql("SELECT id FROM found").collect()) == [15, 16, 17, 18, 19]
