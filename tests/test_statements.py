"""Every registered query agrees with its DuckDB statement on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

STATEMENTS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_a_statement():
    """But those of the training-data operators that SQL can't state; they are tested against plain versions."""
    without = set(entry.queries()) - set(STATEMENTS)
    assert set(STATEMENTS) <= set(entry.queries()) and all(re.match(r"op\d+_|pipeline$", name) for name in without)


@pytest.mark.parametrize("name", STATEMENTS)
def test_query(name, spark, folder, con):
    df = entry.queries()[name](spark, folder)
    assert differences(df, con, STATEMENTS[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
