import pytest

from maskwright.llm import queries
from tests.comparing import connection, rows

SQL = queries.oracle_sql()
COLUMNS = {
    "p1_found": {"name_a": "string", "name_b": "string"},
    "p2_found": {"src": "string", "first_id": "bigint", "copy_id": "bigint"},
    "p3_found": {"src": "string", "row_id": "bigint", "kind": "string", "pii_text": "string"},
    "p4_found": {"src": "string", "row_id": "bigint", "defect": "string", "repaired": "string"},
    "p5_found": {"mapping_id_a": "bigint", "mapping_id_b": "bigint"},
    "p6_found": {"src": "string", "row_id": "bigint", "plain": "string"},
    "p7_found": {"limit_id": "int", "doc_id": "bigint"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert df.count() == df.distinct().count()
    if name in SQL:
        assert rows(df.toPandas()) == rows(connection(small).sql(SQL[name]).df())
    else:
        assert df.toPandas() is not None
