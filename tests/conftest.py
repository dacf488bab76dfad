import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from braid.session import build_session
    s = build_session(master="local[*]", partitions=8, app="braid-tests")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _own_cache(request):
    """What a test caches goes with it: others look at what is persisted."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
