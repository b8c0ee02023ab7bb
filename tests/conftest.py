from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fitweave.session import SPREAD, build_session

    scratch = tempfile.TemporaryDirectory(prefix="fitweave-", ignore_cleanup_errors=True)
    session = build_session(
        "tests", "local[8]",
        **{"spark.checkpoint.dir": scratch.name, "spark.sql.shuffle.partitions": "8", SPREAD: "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    scratch.cleanup()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
