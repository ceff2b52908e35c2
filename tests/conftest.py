import pytest

from tensorloom.runtime import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
