import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fabspark.session import build_session
    s = build_session("local[4]", shuffle_partitions=4)   # checkpoint dir: environment's, or shared_dir's fallback
    yield s
    s.stop()
