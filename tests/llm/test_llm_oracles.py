import os

import pytest

from chunkloom.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(compare, name):
    compare(queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
