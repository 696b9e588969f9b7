"""The corpus queries that SQL can express equal their SQL."""

import pytest

from quillwork.llm import registry
from tests.compare import connection, difference


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, name):
    assert difference(registry.QUERIES[name](spark, sf), connection(sf), registry.ORACLES[name]) is None
