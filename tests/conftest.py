import pytest

from tidewell.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
