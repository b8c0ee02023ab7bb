"""Each query with a SQL twin against it, and the names of all of them."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare, connect  # noqa: E402

from fitweave.llm import queries  # noqa: E402


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    good, detail, _, _ = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert good, detail
