import pytest

import __spark_entry__ as entry
from tensorloom.plans import integrity, pipeline, reference
from tests.sql import connect, rows_of_spark, rows_of_sql

CORE = {**reference.QUERIES, **pipeline.QUERIES, **integrity.QUERIES}
SQL = {**reference.ORACLE, **pipeline.ORACLE, **integrity.ORACLE}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, data, name):
    got = rows_of_spark(CORE[name](spark, data))
    if name in SQL:
        assert got == rows_of_sql(connect(data), SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
