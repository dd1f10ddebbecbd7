"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert entry_point.entry(spark).count() == 200


@pytest.mark.parametrize("name", list(entry_point.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    result = entry_point.queries()[name](spark, SF)
    columns = sorted(result.columns)
    got = sorted((tuple(row[c] for c in columns) for row in result.collect()), key=repr)
    reply = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in reply.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(row[i] for i in at) for row in reply.fetchall()), key=repr)
