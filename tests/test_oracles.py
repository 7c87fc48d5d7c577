import pytest

from bracken.plans import registry
from compare import connection, same


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    same(registry.queries()[name](spark, sf), con, registry.oracle_sql()[name])
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
