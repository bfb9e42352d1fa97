"""Every screening query against its SQL, and the driver's contract."""

import pytest

import __spark_entry__
from tests.oracle import rows_of_spark, rows_of_sql
from veilscan.plans.queries import QUERIES
from veilscan.plans.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert rows_of_spark(QUERIES[name](spark, small)) == rows_of_sql(SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
