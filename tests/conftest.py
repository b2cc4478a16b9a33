import os

import pytest

from readloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "readloom-tests",
        "local[4]",
        4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


def rows(df, *columns):
    """Sorted tuples of a small result."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
