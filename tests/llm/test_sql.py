"""Operators with SQL against DuckDB over whole tables."""

import pytest

from tests.oracle import connect, differences
from weftline.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None
