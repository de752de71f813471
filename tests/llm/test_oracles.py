import pytest

from tests.oracle import SF_DIR, assert_same
from tessera.llm import catalog

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in catalog.QUERIES)] == []
