"""Every registered query equals its SQL, row by row, including types."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from oracle import duck, duck_result, spark_result
from phenotide.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.01"
QUERIES = queries.registered()
ORACLES = oracles.registered()


@pytest.fixture(scope="module")
def connection():
    with duck(SF_DIR) as open_connection:
        yield open_connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, found = spark_result(df)
    expected_columns, expected = duck_result(connection, ORACLES[name])
    assert columns == expected_columns
    described = connection.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    assert {column: TYPES[kind] for column, kind in df.dtypes} == {row[0]: row[1] for row in described}
    assert sum(found.values()) == sum(expected.values()) > 0
    assert found == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
