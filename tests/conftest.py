import pytest

from mosaiq.testing import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session(4, "4g")
