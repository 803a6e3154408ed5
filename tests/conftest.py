import pytest

from palimpsest.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
