import pytest

from rillstone import catalog

from .oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.SQL[name])
