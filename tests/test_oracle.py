"""Every registered query of the library runs; those with SQL give its rows."""

import pytest
from conftest import rows_of

from tessella import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, root, duck, name):
    got = catalogue.QUERIES[name](spark, root)
    assert all(kind != "void" for _, kind in got.dtypes)
    frame = got.toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert rows_of(frame) == rows_of(want)
    else:
        assert len(frame)


def test_sql_has_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
