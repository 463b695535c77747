import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from staylens.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "staylens-tests")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("STAYLENS_TEST_SF", "/root/testdata/sf0.001")
