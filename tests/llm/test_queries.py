import pytest

from feedloom.llm import queries
from tests.compare import connection, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id"], "p3_found": ["name_id_a", "name_id_b"], "p4_found": ["canonical_url", "citations_id", "published_id", "summary_id"], "p5_found": ["id_a", "id_b"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    columns, rows = rows_of(queries.QUERIES[name](spark, FOLDER))
    assert columns == COLUMNS.get(name, columns) and len(rows) == len(set(rows))
    if name in queries.SQL:
        assert (columns, rows) == rows_of_sql(connection(FOLDER), queries.SQL[name])
