"""The llm queries against their SQL."""

import pytest

from echolot.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name]) is None
