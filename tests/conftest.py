"""One small session for all tests."""

import os

import pytest

from quarrylight.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    session = local_session(4, shuffle_partitions=2, app="tests", spark__sql__adaptive__coalescePartitions__enabled="true", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    session.stop()


@pytest.fixture
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables aren't here")
    return SMALL
