import pytest

from graphlens import plans
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, name):
    check(spark, plans.QUERIES[name], plans.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
