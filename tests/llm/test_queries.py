import os

import pytest

from quirefold.llm import catalog
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert same(spark, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
