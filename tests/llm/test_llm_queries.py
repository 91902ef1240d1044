import pytest
from oracle import SMALL, database, same

from tarnwell.llm import queries


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], db)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).count() >= 0


def test_case_columns(spark):
    columns = {
        "p1_found": ["number", "term"], "p2_found": ["kind", "id_a", "id_b"], "p3_found": ["number", "cluster_number"], "p4_found": ["run_id"],
        "p5_found": ["number", "break_at"], "p6_found": ["query_id", "number"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    for name, want in columns.items():
        assert queries.queries()[name](spark, SMALL).columns == want
