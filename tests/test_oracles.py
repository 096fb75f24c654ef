"""Every query with SQL gives what DuckDB gives; every other gives rows."""

import os

import pytest

from chunkloom.plans import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(compare, name):
    compare(registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
