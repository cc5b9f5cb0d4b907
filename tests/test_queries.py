"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from shelfloom.plans.oracle import ORACLE
from shelfloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns == ["issue_type", "severity", "issues"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = database.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    assert {c: KINDS[t] for c, t in frame.dtypes} == kinds
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    found = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
