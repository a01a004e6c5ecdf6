import pytest

from strandloom.plans import registry

from .oracle import HAVE, SF, check

pytestmark = pytest.mark.skipif(not HAVE, reason="needs the test tables")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
