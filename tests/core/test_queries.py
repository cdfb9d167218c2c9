import pytest

from maskwright import queries
from tests.comparing import connection, rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    found = queries.queries()[name](spark, small).toPandas()
    if name in SQL:
        assert rows(found) == rows(connection(small).sql(SQL[name]).df())
    else:
        assert len(found.columns) > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(queries.queries())
