import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_option(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield set_option
    for key, value in before.items():
        spark.conf.set(key, value)
