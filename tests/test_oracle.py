"""Every registered query against its DuckDB restatement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = os.environ.get("DATA", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_restatement():
    own = {*entry.llm.QUERIES, "pipeline"} if entry.llm else set()
    assert set(entry.queries()) - own == set(SQL) - own


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
