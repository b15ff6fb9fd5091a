from __future__ import annotations

import pytest
from oracle import connect, duck_rows, spark_rows

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, sf_dir, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, sf_dir).count() > 0
        return
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    want_columns, want = duck_rows(con, SQL[name])
    assert columns == want_columns
    assert len(rows) == len(want) and len(rows) > 0
    assert rows == want


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
