"""Every registered query with SQL gives the rows of DuckDB on the same tables."""

import pytest

from tests.conftest import SF_DIR, comparable
from touchline.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF_DIR)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(found.columns, found.collect()) == comparable(columns, want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
