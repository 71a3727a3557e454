import pytest

from ledgerlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "8")
