import os

import pytest

from vigilia.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(int(os.environ.get("TEST_CPUS", "8")), 4, "6g", str(tmp_path_factory.mktemp("work")))


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
