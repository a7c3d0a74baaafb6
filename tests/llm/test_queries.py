"""The subpackage's queries on whole small tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

NAMES = sorted(n for n, q in entry.queries().items() if q.__module__ == "embermill.llm.queries")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    pdf = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert compare(pdf, connect(data), sql) == "OK"
    else:
        assert len(pdf) > 0
