import pytest
from oracle import SMALL, database, same

from tarnwell import queries


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, db, name):
    same(queries.QUERIES[name](spark, SMALL), queries.SQL[name], db)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0
