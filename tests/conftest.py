import pytest

from spanloom.session import local


@pytest.fixture(scope="session")
def spark():
    s = local(4, 4, "4g")
    yield s
    s.stop()
