"""Every registered query against its SQL twin on the smallest dataset."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402

from fitweave.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    query = catalog.QUERIES[name]
    good, detail, _, _ = compare(spark, con, sf, name, query.build, query.sql)
    assert good, detail
