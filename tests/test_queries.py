"""Every registered query against its SQL counterpart."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from fluentrail.functions import text
from fluentrail.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return connection


def test_oracles_have_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert set(registered.queries()) - set(registered.oracle_sql()) - set(registered.EXTRA) == set()


@pytest.mark.parametrize("name", sorted(set(registered.oracle_sql()) - set(registered.EXTRA)))
def test_query_equals_sql(spark, sf, sql, name):
    df = registered.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(row[c] for c in names) for row in df.collect()]
    answer = sql.execute(registered.oracle_sql()[name])
    places = [[d[0] for d in answer.description].index(c) for c in names]
    assert len(answer.description) == len(names)
    wanted = [tuple(row[i] for i in places) for row in answer.fetchall()]
    assert wanted, "nothing to compare"
    assert not any(isinstance(v, float) and math.isnan(v) for row in got for v in row)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.count() == 200 and "severity_score" in df.columns


def test_file_listing(spark, sf):
    listed = files.list_files(spark, sf, "*.parquet")
    rows = listed.select(text.file_name(F.col("uri")).alias("name"), "content_type", "length").collect()
    assert {r.name for r in rows} == {f"{name}.parquet" for name in TABLES.split()}
