import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from nudgeframe.session import local_session  # noqa: E402

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture
def split_small_inputs(spark):
    """Take the large-input paths on small data."""
    spark.conf.set("spark.nudgeframe.smallBytes", "0")
    spark.conf.set("spark.nudgeframe.rowsPerTask", "25")
    yield
    spark.conf.unset("spark.nudgeframe.smallBytes")
    spark.conf.unset("spark.nudgeframe.rowsPerTask")


@pytest.fixture(scope="session")
def duck():
    from tests.compare import open_duckdb

    return open_duckdb(SMALL_DIR)
