import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from outlay.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def now(spark):
    from outlay.functions.dates import ts_lit

    return ts_lit(dt.datetime(2026, 9, 21, 2, 0, 0))


@pytest.fixture
def frame(spark):
    """DataFrame from a DDL schema and rows of tuples."""

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make
