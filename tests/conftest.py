import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8, "corpusloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def column(spark):
    """Values of a column expression over rows given as tuples."""

    def run(rows, schema, expression):
        return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expression).collect()]

    return run
