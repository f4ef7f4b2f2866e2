import pytest

from ledgerloom.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "ledgerloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL
