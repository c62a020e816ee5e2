"""Every query with a SQL twin gives the same rows on both engines."""

import pytest
from oracle import compare

from tidewatch.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    ok, message = compare(spark, duck, folder, name, catalog.QUERIES[name], catalog.SQL[name])
    assert ok, message
