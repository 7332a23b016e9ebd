import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trustlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(app="tests", master="local[8]", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a small table from tuples and a schema text."""
    return lambda values, schema: spark.createDataFrame(values, schema)
