import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("MURMUR_DRIVER_MEMORY", "6g")

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from murmur.session import checkpoint_root, local_session

    s = local_session("*", shuffle_partitions=8, app="murmur-tests")
    checkpoint_root(s)
    yield s
