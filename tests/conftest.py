"""One small local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quern.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session("local[8]", 2, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
