import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from netprism.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _release():
    yield
    release()


@pytest.fixture
def lines_of(spark):
    """Texts by file name to numbered lines."""
    def make(**files):
        rows = [(name, i, line) for name, text in files.items() for i, line in enumerate(text.strip("\n").split("\n"), start=1)]
        return spark.createDataFrame(rows, "file_id string, line_no long, text string")
    return make
