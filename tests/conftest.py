import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """A DataFrame of lines as read from one file."""

    def make(lines, file_name="f.log"):
        rows = [(line, file_name, 0, i) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "line string, file_name string, block_start long, scan_pos long").coalesce(1)

    return make
