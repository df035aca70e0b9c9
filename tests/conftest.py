import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """``files({path: text or bytes})`` as a content table."""

    def make(contents):
        rows = [(p, c.encode() if isinstance(c, str) else c) for p, c in contents.items()]
        return spark.createDataFrame(rows, "path string, content binary")

    return make


@pytest.fixture
def listing(spark):
    return lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
