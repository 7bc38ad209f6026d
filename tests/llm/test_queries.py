"""The training-data queries against their SQL on the tables that the core's are compared on."""

from __future__ import annotations

import pytest

from tests.conftest import TABLES
from tests.oracle import compare
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    fn = queries.QUERIES[name]
    if name in queries.SQL:
        may = {"p8_copies": {"records", "representative"}}.get(name, ())  # one pair of copies
        ok, said = compare(spark, name, fn, queries.SQL[name], TABLES, frozenset(may))
        assert ok, said
    else:
        assert fn(spark, TABLES).count() > 0
