import pytest

from rillstone.llm import queries

from ..oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert len(df.collect()) > 0


def test_surprise_has_every_pair_with_a_common_user(spark):
    columns = ("b1", "b2", "c", "n1", "n2")
    sql = f"WITH {queries.REVIEWS}, {queries._EDGES}, {queries._COMMON} SELECT {', '.join(columns)} FROM p"
    compare(spark, lambda s, d: queries.p5_surprise(s, d).select(*columns), sql)
