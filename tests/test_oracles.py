"""Every registered query of the domain against its SQL."""

import oracle
import pytest
from conftest import SF

from tessella import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert oracle.differences(spark, con, registry.queries()[name], SQL[name], SF) is None


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
