import __spark_entry__ as entry
import pytest
from oracle import rows_of, sql_rows

from tidemark.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows_of(entry.queries()[name](spark, sf).toPandas()) == sql_rows(SQL[name], sf)


def test_entry_runs_and_every_query_is_registered(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
