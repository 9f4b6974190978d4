import pytest

from tidewright.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
