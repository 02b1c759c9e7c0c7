import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from memberrisk.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app_name="memberrisk-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mr-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="mr-test-", dir="/tmp")


SMOKE = "/root/testdata/sf0.001"
