import pytest

from tessella.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
