import pytest

from tensorloom.llm import queries
from tests.sql import connect, rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = rows_of_spark(queries.QUERIES[name](spark, data))
    if name in queries.ORACLE:
        assert got == rows_of_sql(connect(data), queries.ORACLE[name])
    elif name not in ("p4_found", "p6_report"):
        assert got[1]
