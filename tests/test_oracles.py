"""Every query with SQL gives the rows of its SQL."""

import pytest

from sparrowlane import registry

from .oracle import assert_same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, tiny):
    assert_same(registry.queries()[name], SQL[name], spark, tiny)
