import pytest

from basalt.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4, memory="3g")
    yield s
    s.stop()
